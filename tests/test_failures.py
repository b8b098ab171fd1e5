"""Models that fail, hidden content of all spellings, and totals by grouping sets."""

import pytest
from pyspark.sql import functions as F

from inkveil.operators import evaluate, hidden, model


def chunks_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, page int, chunk int, text string")


def test_a_failed_chunk_is_a_row_and_takes_no_other_with_it(spark):
    def fussy():
        def run(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[{"idx": 0, "tag": "B-X", "score": 1.0, "piece": t}] for t in texts]

        return run

    rows = chunks_of(spark, ("a", 1, 0, "good"), ("a", 1, 1, "bad one"), ("b", 1, 0, "fine"), ("c", 1, 0, "y" * 30), ("c", 1, 1, None), ("d", 2, 0, "bad"), ("e", 1, 0, ""))
    for size in (1, 1 << 20):
        scored = model.score_chunks(rows.coalesce(1), fussy, most_chars=20, batch_bytes=size)
        got = {(r["doc_id"], r["chunk"]): (r["status"], r["error"], [t["piece"] for t in r["tokens"]]) for r in scored.collect()}
        assert got == {("a", 0): ("ok", None, ["good"]), ("a", 1): ("failed", "ValueError: no", []), ("b", 0): ("ok", None, ["fine"]), ("c", 0): ("skipped", None, []), ("c", 1): ("skipped", None, []), ("d", 0): ("failed", "ValueError: no", []), ("e", 0): ("ok", None, [""])}
    flags = {r["doc_id"]: (r["chunks"], r["failed"], r["skipped"], r["model_used"], r["fell_back"], r["error"]) for r in model.model_flags(scored).collect()}
    assert flags == {"a": (2, 1, 0, False, True, "ValueError: no"), "b": (1, 0, 0, True, False, None), "c": (2, 0, 2, False, False, None), "d": (1, 1, 0, False, True, "ValueError: no"), "e": (1, 0, 0, True, False, None)}
    first = model.tokens_of(scored).select("doc_id", F.col("piece").alias("v"))
    second = rows.select("doc_id", F.lit("else").alias("v")).distinct()
    assert sorted(map(tuple, model.scored_or(scored, first, second).collect())) == [("a", "else"), ("b", "fine"), ("d", "else"), ("e", "")]


def test_batches_are_bounded_by_bytes_and_results_are_counted(spark):
    def load():
        def run(texts):
            if sum(map(len, texts)) > 10 and len(texts) > 1:
                raise MemoryError("too much")
            return [[]] if len(texts) == 1 and texts[0] == "short" else [[]] * len(texts) if "lost" not in texts else []

        return run

    rows = chunks_of(spark, *[("a", 1, k, "12345") for k in range(9)], ("b", 1, 0, "lost"), ("b", 1, 1, "x" * 15))
    got = [(r["doc_id"], r["chunk"], r["status"]) for r in model.score_chunks(rows.coalesce(1), load, batch_bytes=10).orderBy("doc_id", "chunk").collect()]
    assert got == [*[("a", k, "ok") for k in range(9)], ("b", 0, "failed"), ("b", 1, "ok")]


def test_a_model_that_does_not_load_fails_all(spark):
    def load():
        raise OSError("no weights")

    assert [r["error"] for r in model.score_chunks(chunks_of(spark, ("a", 1, 0, "t")), load).collect()] == ["OSError: no weights"]


HTML = [
    ('<textarea name="n">SSN 123-45-6789</textarea>after', "after", ["form data"]),
    ("<p title='Ann Lee' class=x>t</p>", "<p class=x>t</p>", ["alternative text"]),
    ("<img alt=Ann src=a>", "<img src=a>", ["alternative text"]),
    ('<IMG SRC="a" ALT = "Ann > Lee">z', '<IMG SRC="a">z', ["alternative text"]),
    ("<p data-x=\" title='no' alt=no \">t</p>", "<p data-x=\" title='no' alt=no \">t</p>", []),
    ("a < b title=\"c\" and <b>d</b>", "a < b title=\"c\" and <b>d</b>", []),
    ("<button type=submit>Send <b>Ann</b></button><select><option>Ann</select>x<input value='a>b'/>y", "xy", ["form data"]),
    ("<object data=f><object>in</object>still</object>out<embed src=f>", "out", ["attachments"]),
    ("<!-- <textarea> -->t<script>var x = '<!--';</script>u<META name=a>", "tu", ["metadata", "scripts", "comments"]),
    ("x<textarea>never closed <b>Ann</b>", "x", ["form data"]),
    ("</textarea>x</object>y", "xy", ["attachments", "form data"]),
    ("<p title=\"unclosed>text", "<p title=\"unclosed>text", []),
    ("x<!-- open", "x", ["comments"]),
    ("", "", []), (None, None, []), ("no tags", "no tags", []), ("<title>kept</title>", "<title>kept</title>", []), ("<subtitle=a title>t", "<subtitle=a title>t", []),
]


def test_hidden_content_of_all_spellings(spark):
    rows = spark.createDataFrame([(k, h) for k, (h, _, _) in enumerate(HTML)], "k int, html string")
    got = {r["k"]: (r["out"], r["kinds"]) for r in rows.select("k", hidden.strip_hidden(F.col("html")).alias("out"), hidden.removal_report(F.col("html")).alias("kinds")).collect()}
    for k, (html, out, kinds) in enumerate(HTML):
        assert got[k] == (out, kinds), html


def test_a_page_of_very_many_tags(spark):
    html = "<p class='a' title=\"b\">x</p><!-- c -->" * 20_000 + "<b " + "a" * 200_000 + ">"
    r = spark.createDataFrame([(html,)], "html string").select(hidden.strip_hidden(F.col("html")).alias("out")).first()["out"]
    assert r == "<p class='a'>x</p>" * 20_000 + "<b " + "a" * 200_000 + ">"


def test_totals_by_grouping_sets(spark):
    done = spark.createDataFrame([(1, 1, "x@y.z and Ann", "█████ and Ann"), (2, 1, "Bob", "███"), (3, 1, "none", "none")], "doc_id long, page int, text string, redacted_text string")
    want = spark.createDataFrame([(1, "x@y.z", "Email"), (1, "Ann", "Person"), (2, "Bob", "Person")], "doc_id long, value string, type string")
    found = spark.createDataFrame([(1, "x@y.z", "Email"), (2, "Bob", "Person"), (3, "none", "Person")], "doc_id long, value string, type string")
    sources = spark.createDataFrame([(1, "s"), (2, "s"), (3, None)], "doc_id long, source string")
    got = {(r["source"], r["type"], r["level"]): (r["n_expected"], r["n_missed"], r["n_detected"], r["n_false"]) for r in evaluate.evaluate_rollup(want, found, done, sources).collect()}
    assert got == {
        ("s", "Email", 0): (1, 0, 1, 0), ("s", "Person", 0): (2, 1, 1, 0), (None, "Person", 0): (0, 0, 1, 1), ("s", None, 1): (3, 1, 2, 0), (None, None, 1): (0, 0, 1, 1),
        (None, "Email", 2): (1, 0, 1, 0), (None, "Person", 2): (2, 1, 2, 1), (None, None, 3): (3, 1, 3, 1),
    }
    rows = {r["doc_id"]: (r["n_expected"], r["n_missed"], r["n_detected"], r["n_false"]) for r in evaluate.evaluate_documents(want, found, done).collect()}
    assert rows == {1: (2, 1, 1, 0), 2: (1, 0, 1, 0), 3: (0, 0, 1, 1)}


@pytest.mark.parametrize("values", [[], [(9, None, "Email")]])
def test_a_document_without_values_is_not_lost(spark, values):
    done = spark.createDataFrame([(1, 1, "t", "t")], "doc_id long, page int, text string, redacted_text string")
    none = spark.createDataFrame([], "doc_id long, value string, type string")
    rows = evaluate.evaluate_documents(spark.createDataFrame(values, "doc_id long, value string, type string"), none, done).collect()
    assert sorted((r["doc_id"], r["n_expected"], r["catch_rate"]) for r in rows) == [(k, 0, 0.0) for k in sorted({1, *(v[0] for v in values)})]
