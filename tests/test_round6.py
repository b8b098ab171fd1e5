"""Findings of round 4."""

from inkveil.operators import locate
from inkveil.plans import pipeline, queries
from inkveil.sources import pages as sources


def test_values_that_share_their_first_word_meet_their_own_places_only(spark, monkeypatch):
    n, joined, make = 300, [], locate.once
    pages = spark.createDataFrame([(1, k, f"call +1 (202) 555-{1000 + k}, or 1 of 555") for k in range(n)], "doc_id long, page long, text string")
    values = spark.createDataFrame([(1, f"+1 (202) 555-{1000 + k}") for k in range(n)], "doc_id long, value string")
    monkeypatch.setattr(locate, "once", lambda rows, *x: (joined.append(rows), make(rows, *x))[1])
    found = locate.locate(values, pages, by_word=True)
    assert sorted((r["value"], r["page"], r["n"]) for r in found.collect()) == [(f"+1 (202) 555-{1000 + k}", k, 1) for k in range(n)]
    assert [rows.count() for rows in joined] == [n]


def test_texts_do_not_move_where_all_values_hold_words(spark):
    pages = spark.createDataFrame([(1, 1, "ann lee")], "doc_id long, page long, text string")
    values = spark.createDataFrame([(1, "Ann Lee")], "doc_id long, value string")
    assert "text#" not in locate.locate(values, pages, by_word=True)._jdf.queryExecution().executedPlan().toString()


def test_of_matches_of_one_word_that_overlap_the_first_stands(spark):
    pages = spark.createDataFrame([(1, 1, "--a---a-- x"), (1, 2, "a-a -a-"), (1, 3, "-a- ÉÉ -A-"), (2, 1, "-a-")], "doc_id long, page long, text string")
    values = spark.createDataFrame([(1, "--a--"), (1, "-a-"), (1, "a"), (1, "A-A")], "doc_id long, value string")
    rows = lambda by: sorted((r["value"], r["page"], [(x["s"], x["e"], x["value"]) for x in r["spans"]]) for r in locate.locate(values, pages, by).collect())
    assert rows(True) == rows(False)
    assert ("--a--", 1, [(0, 5, "--a--")]) in rows(True)


def test_values_of_very_different_lengths_and_none(spark):
    long = " ".join(f"w{k % 7}" for k in range(300))
    pages = spark.createDataFrame([(1, 1, f"w0 {long} w1 w2"), (1, 2, None), (1, 3, "")], "doc_id long, page long, text string")
    values = spark.createDataFrame([(1, long), (1, "w0"), (1, "w0 w1"), (1, "w6 w0"), (1, "w1 w3")], "doc_id long, value string")
    rows = lambda own, by: sorted((r["value"], r["page"], r["n"]) for r in locate.locate(own, pages, by).collect())
    assert rows(values, True) == rows(values, False) and len(rows(values, True)) == 4
    assert rows(values.where("false"), True) == []


def test_review_list_searches_the_texts_once(spark, folder, monkeypatch):
    calls, detect = [], pipeline.detect
    monkeypatch.setattr(queries.pipeline, "detect", lambda *x, **y: (calls.append(x), detect(*x, **y))[1])
    listed = queries.review_list(spark, folder)
    assert len(calls) == 1
    assert listed.count() == locate.match_summary(locate.locate(queries._source_entities(spark, folder), sources.source_pages(spark, folder))).count() > 0
