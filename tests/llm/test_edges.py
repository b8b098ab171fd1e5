"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and columns
whose names clash with the operators' own."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from inkveil.llm import bpe, embedding_dedup, kd_shards, multiset_hash, packing, simhash, substring_dedup, token_store, toxicity, url_filter
from inkveil.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, ord int, fp string, word string, part int, key string, id long, size int, shard int, bucket int, block int, rn int, after string, score double, node int, row int, label string, _row_id int, _ord int, _th int"
LONG = "x" * 5000 + " " + " ".join(f"w{k % 97}" for k in range(4000))
TEXTS = [(0, "one two three"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, "same id, other text"), (5, "same id, other text"), (None, "no id"), (None, None), (6, "one two three"), (7, "ünï 漢字 🙂 <|endoftext|>")]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 2 else "s", None if t is None else len(t), *[None] * 20) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return rows_of(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return rows_of(spark, [])


def store(docs, tmp_path, name):
    path = str(tmp_path / name)
    token_store.store_documents(docs, path, tokenizer_file("word_bpe_49k.json"), 1, 49408)
    return token_store.store_digest(docs.sparkSession, path, 49408)


def field():
    return toxicity.fit([], [], {})


OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, tokenizer_file("byte_bpe_50k.json")),
    "toxicity": lambda d: toxicity.scored(d, field()),
    "simhash": simhash.near_duplicates,
    "multiset_hash": multiset_hash.compared,
    "substring": substring_dedup.substring_report,
    "shards": lambda d: kd_shards.sharded(d, 3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, docs, empty):
    out = OPERATORS[name](docs)
    assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str) == sorted((i for i, _ in TEXTS), key=str)
    assert OPERATORS[name](empty).count() == 0


def test_store_orders_null_ids_first(docs, empty, tmp_path):
    out = store(docs, tmp_path, "a").orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, 0, 1, 2, 3, 4, 5, 5, 5, 6, 7]
    assert out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
    assert store(empty, tmp_path, "b").count() == 0


def test_equal_texts_are_alike(docs):
    found = {(r["doc_id"], r["fingerprint"]): r for r in multiset_hash.compared(docs).collect()}
    zero, six = (next(r for (i, _), r in found.items() if i == k) for k in (0, 6))
    assert zero["fingerprint"] == six["fingerprint"]
    near = {}
    for r in simhash.near_duplicates(docs).collect():
        near.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert near[0] == near[6] and {c for _, c in near[1] | near[2] | near[3]} == {1} and {f for f, _ in near[1]} == {"0" * 16}


def test_one_of_each_keeps_columns(docs, empty):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"] is None) for r in out.where("doc_id is not null").collect())
    assert [i for i, _ in kept] == [0, 1, 4, 5, 7]
    assert simhash.one_of_each(empty).count() == 0


def test_cut_documents_keep_columns(docs, empty):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id in (0, 4, 6)").collect()}
    assert got[0] == got[6] == "one two three"
    assert out.where("doc_id = 5").count() == 2  # the copy of 4 keeps no word
    assert substring_dedup.without_repeats(empty).count() == 0


def test_toxicity_passes_rows_through(docs, empty):
    assert toxicity.accepted(docs, field()).count() == len(TEXTS)
    assert toxicity.accepted(empty, field()).columns == docs.columns
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, labels)).where("score between 0 and 1").count() == len(TEXTS)


def test_packing_of_odd_rows(docs, empty):
    out = packing.packed(packing.document_items(docs), 1000)
    total = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).where("doc_id = 4").first()["n"]
    assert total == 4002
    assert packing.packed(packing.document_items(empty), 1000).count() == 0


def test_pipeline_on_odd_rows(docs, tmp_path):
    spark = docs.sparkSession
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, -0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 1)]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == len(rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (10, 2, 0, False)]
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_urls(spark):
    urls = [None, "", "nothing", "HTTPS://WWW.Example.COM/en/7?x", "http://a.b.example.net/de/8/9", "x://example.org/es/#", "http://net?de/", "http://É.net/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judged(pages, url_filter.labelled_urls(spark)).collect()}
    assert out[0] == out[1] == out[2] == ("", "", None)
    assert out[3] == ("www.example.com", "/en/7", "example.com/en/7")
    assert out[4] == ("a.b.example.net", "/de/8/9", "example.net/de/8")
    assert out[5] == ("example.org", "/es/", "org/es/")
    assert out[6] == ("net", "", None)
    assert out[7] == ("É.net", "/de/", "net/de/")
