"""Values are found by the index of words just where a search of the texts finds them."""

import random

import pytest

from inkveil.operators import locate

WORDS = ["Ann", "ann", "Lee", "a+b", "(555) 1", "xAnn", "élan", "É", "\n", "annlee", "B", "of", "a.b@c.de", "C.DE", "_", "a_b", "x", "((", "1", "ann lee ann", "o'hara"]
VALUES = ["ann", "ann lee", "lee ann", "ann lee ann", "A+B", "(555) 1", "(555)", "élan", "É", "Lee  a+b", " ", "none", "a.b@c.de", "c.de", "of B", "***", "((", "x", "a_b", "O'Hara", "1", "(ann", "ann)", "ann ann", "꙯ꙮ", "_"]


@pytest.mark.parametrize("bits", [1 << 20, 32, 0])
def test_index_equals_search(spark, monkeypatch, bits):
    """Also where the words are told as bits, and where these let most words pass."""
    monkeypatch.setattr(locate, "_LISTED_WORDS", 4096 if bits else 0)
    bits = bits or 1 << 20
    monkeypatch.setattr(locate, "_LEAST_BITS", min(bits, 1 << 12))
    monkeypatch.setattr(locate, "_MOST_BITS", bits)
    rng = random.Random(9)
    rows = [(k % 4, k, None if k == 5 else "".join(rng.choice(WORDS) + rng.choice([" "] * 6 + ["  ", ", ", "", "(", ")", "\n", " "]) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    pages = spark.createDataFrame([*rows, (7, 1, "ꙮ ann ꙮ")], "doc_id long, page long, text string")
    values = spark.createDataFrame([(k, v) for k in range(8) for v in VALUES] + [(1, None)], "doc_id long, value string")
    found = lambda by: sorted((r["doc_id"], r["value"], r["page"], r["n"], [(x["s"], x["e"], x["value"]) for x in r["spans"]]) for r in locate.locate(values, pages, by).collect())
    got, want = found(True), found(False)
    assert got == want and len(want) > 1000


def test_no_text_moves(spark):
    pages = spark.createDataFrame([(1, 1, "ann lee")], "doc_id long, page long, text string")
    values = spark.createDataFrame([(1, "Ann Lee")], "doc_id long, value string")
    phrases = values.selectExpr("doc_id", "value", "array('ann', 'lee') AS words")
    plan = locate.located(phrases, locate.word_index(pages, phrases))._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan
