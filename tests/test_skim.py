"""The skimmed search finds just what a search of the whole text finds."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions.fixed import spelled
from inkveil.functions.skim import skimmed, spans_in
from inkveil.functions.text import find_spans
from inkveil.operators.detectors import CANDIDATE, DETECTORS, candidates_of, claimed, claimed_rows, claims_table, pattern_entities

PARTS = [
    "a@b.co", "x.y+z@mail.example.org", "10.0.0.1", "1.2.3.4.5", "fe80::1", "fe::ab", "::1", "2001:db8:0:0:0:0:2:1", "4111 1111 1111 1111", "4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32",
    "DE89 3704 0044 0532 0130 00", "AB12 WXYZ WXYZ WXYZ WXYZ WXYZ WXYZ WXYZ ABCD tail", "123-45-6789", "123\n45 6789", "123456789", "born on 1/2/1990", "year of birth : : 1980", "year of birth", "born in", "1975", "date of birth", "January 5, 2020", "5 January 2020",
    "January", "2020", "passport card no . # AB12345", "passport", "card", "no", "number", "num.", "#", "(", ")", ").", ":", ".", "visa", "V-5000", "case file no. 30000", "driver's license", "license", "plate", "KX-700", "id", "serial", "12-2020-1000000-QX",
    "1:21-cr-10000-ABC", "Dr", "Dr.", "Mr.", "Judge", "(Mrs.", "Ann", "O'Hara", "B.", "Smith-Jones", "+1 (212) 555-1234", "(212) 555-1234", "212.555.1234", "+44 20 7946 0958", "plain", "words", "of", "text", "in", "between", "Émile", "été", "a", "I", "\u0001", "9Mr.", "Mr.x",
]
GLUE = [" "] * 12 + ["  ", "\n", "\n\n", "\t", " ", ", ", "; ", "", "."]


def texts(n, seed):
    rng = random.Random(seed)
    out = ["", " ", "Mr. Ann", "x" * 5000, "plain words " * 500, "a " * 40 + "a@b.co" + " a" * 40, "\u0000 call (212) 555-1234", "::1"]
    for _ in range(n):
        plain = rng.random()
        out.append("".join((rng.choice(PARTS) if rng.random() > plain else rng.choice(["plain", "words", "of", "text", "Word"])) + rng.choice(GLUE) for _ in range(rng.randint(1, 60))))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts(1500, 5))], "doc_id long, page int, text string").repartition(4).cache()


def test_skimmed_search_equals_full_search(pages):
    text = F.col("text")
    rows = pages.select("text", skimmed(text).alias("k"))
    # One aggregation for each pattern, so that no plan holds them all.
    for p in DETECTORS:
        full, skim = find_spans(text, spelled(p.regex), p.group), spans_in(F.col("k"), spelled(p.regex), p.group)
        r = rows.select(full.alias("a"), skim.alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("bad"), F.sum(F.size("a")).alias("n")).first()
        assert r["bad"] == 0 and r["n"] > 10, (p, r)


def test_skimmed_claims_equal_full_claims(pages):
    text = F.col("text")
    full = pages.select("doc_id", claimed(candidates_of(text)).alias("c"))
    both = full.join(claims_table(pages), "doc_id", "left").select("c", F.coalesce("claims", F.array().cast(f"array<{CANDIDATE}>")).alias("d"))
    assert both.where("c <> d").count() == 0 and both.where("size(c) > 3").count() > 100


def test_long_plain_text_is_left_out(spark):
    text = "plain words " * 5000 + "call (212) 555-1234 now " + "plain words " * 5000
    r = spark.createDataFrame([(text,)], "text string").select(skimmed(F.col("text")).alias("k")).first()["k"]
    assert len(r["short"]) < 200 and len(r["cuts"]) == 2


def test_a_search_is_made_once(spark, pages):
    """The optimizer doesn't copy the search into a filter, and a table of claims has none in its plan."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan(pattern_entities(pages.select("*"))).split("\n") if x.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("regexp" in x or "aggregate" in x for x in filters)
    assert "regexp_extract_all" not in plan(claimed_rows(claims_table(pages)))
