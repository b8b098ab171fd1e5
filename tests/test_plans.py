"""Numbering in ranges, redaction in one join, and containment by shared characters."""

import random

from pyspark.sql import functions as F

from inkveil.operators import entities, evaluate, layout, locate, redact


def test_a_document_is_numbered_by_many_tasks(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, page int, s int").repartition(5)
    out = entities.numbered(df, ["page", "s"])
    want = {}
    for d, p, s in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[(d, p, s)] = sum(1 for x in want if x[0] == d) + 1
    assert {(r["doc_id"], r["page"], r["s"]): r["ord"] for r in out.collect()} == want
    # The hot document's rows lie in several ranges, so several tasks number them.
    ranges = df.repartitionByRange(4, "doc_id", "page", "s").where("doc_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges > 1
    assert entities.numbered(df.where("false"), ["page", "s"]).count() == 0
    assert entities.numbered(df.withColumn("ord", F.lit(7)), ["page", "s"]).columns == ["doc_id", "page", "s", "ord"]


def test_values_redact_as_spans_do(spark):
    rng = random.Random(4)
    words = ["Ann", "ann", "Ann Lee", "Lee", "a+b", "(555) 1", "xAnn", "élan", "Ann  Lee", "\n", "annlee", "B"]
    pages = spark.createDataFrame([(k % 20, k, None if k == 3 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(120)] + [(50, 1, "no values")], "doc_id long, page long, text string")
    values = spark.createDataFrame([(k, v) for k in range(21) for v in rng.sample(["ann", "ann lee", "lee", "A+B", "(555) 1", "élan", "Lee  a+b", " ", "none"], 5)] + [(1, None)], "doc_id long, value string")
    for mask in ("block", "-"):
        want = redact.redact_text(pages, redact.span_union(locate.locate(values, pages)), mask)
        got = redact.redact_values(pages, values, mask)
        assert got.columns == ["doc_id", "page", "text", "n_redacted", "redacted_text"]
        key = lambda df: sorted((r["doc_id"], r["page"], r["n_redacted"], r["redacted_text"]) for r in df.collect())
        assert key(got) == key(want) and sum(r[2] for r in key(got)) > 200


def test_unlike_values_hold_and_are_held_by_none(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    found = {(k % 6, word()) for k in range(80)}
    want = [(k % 5, word()) for k in range(12)] + [(0, "")]
    got = evaluate.unlike(spark.createDataFrame(list(found), "doc_id long, d string"), spark.createDataFrame(want, "doc_id long, v string"))
    brute = {(i, d) for i, d in found if not any(i == j and v and (v in d or d in v) for j, v in want)}
    assert {tuple(r) for r in got.collect()} == brute and 0 < len(brute) < len(found)


def brute_text(items, tolerance=4):
    anchors, rows = [], {}
    for ord_, x, y, text in sorted(items):
        a = next((a for a in anchors if abs(a - y) <= tolerance), None)
        if a is None:
            a = y
            anchors.append(a)
        rows.setdefault(a, []).append((x, ord_, text))
    return "\n".join(" ".join(t for _, _, t in sorted(rows[a])) for a in sorted(rows))


def test_reading_order_of_dense_pages(spark):
    rng = random.Random(8)
    pages = {k: [(n, round(rng.random() * 9, 1), round(rng.random() * rng.choice([20, 200, 2000]), 1), f"t{n}") for n in range(rng.randint(1, 150))] for k in range(40)}
    df = spark.createDataFrame([(k, 1, *i) for k, items in pages.items() for i in items], "doc_id long, page int, ord int, x double, y double, text string")
    assert {r["doc_id"]: r["text"] for r in layout.page_text(df).collect()} == {k: brute_text(items) for k, items in pages.items()}


def test_a_page_of_very_many_lines(spark):
    df = spark.range(100_000).selectExpr("1L AS doc_id", "1 AS page", "id AS ord", "cast(id % 10 as double) AS x", "cast(12 * (id div 10) + id % 3 as double) AS y", "concat('w', id) AS text")
    text = layout.page_text(df).first()["text"].split("\n")
    assert len(text) == 10_000 and text[7] == " ".join(f"w{70 + k}" for k in range(10))
