import pytest
from pyspark.sql import functions as F

from inkveil.functions.text import find_spans, occurrences
from inkveil.operators.detectors import is_claimed, pattern_entities, with_claims
from inkveil.plans.pipeline import detect


def found(spark, text):
    rows = pattern_entities(spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")).collect()
    return [(r["type"], r["value"]) for r in sorted(rows, key=lambda r: (r["rank"], r["pat"], r["s"]))]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("mail a.b+c@x-y.example.com now", [("Email", "a.b+c@x-y.example.com")]),
        ("bad a..b@x.com", []),
        ("10.0.0.1 and 300.1.1.1", [("IP Address", "10.0.0.1")]),
        ("fe80::1 or 1::2::3", [("IP Address", "fe80::1")]),
        ("4111 1111 1111 1111 and 4111 1111 1111 1112", [("Credit Card", "4111 1111 1111 1111")]),
        ("GB82 WEST 1234 5698 7654 32", [("IBAN", "GB82 WEST 1234 5698 7654 32")]),
        ("GB82 WEST 1234 5698 7654 33", []),
        ("123-45-6789 000-45-6789 666-45-6789 923-45-6789 123-00-6789 123-45-0000", [("SSN", "123-45-6789")]),
        ("born on 04/05/1980", [("Date of Birth", "04/05/1980")]),
        ("due on 04/05/1980", []),
        ("yob: 1975", [("Date of Birth", "1975")]),
        ("Passport card no. AB-1234", [("Passport", "AB-1234")]),
        ("case 1:21-cr-12345-ABC", [("Case Number", "1:21-cr-12345-ABC")]),
        ("12-2020-1234567-QX", [("Case Number", "12-2020-1234567-QX")]),
        ("Case file no. 12345", [("Case Number", "12345")]),
        ("docket case 21-4455", [("Case Number", "21-4455")]),
        ("application file 2020-77", [("Case Number", "2020-77")]),
        ("serial badge 12345", [("ID Number", "12345")]),
        ("badge serial: AB1234", [("ID Number", "AB1234")]),
        ("driver's license: D1234567", [("ID Number", "D1234567")]),
        ("Judge Mary J. O'Hara spoke", [("Person", "Mary J. O'Hara")]),
        ("éMr. Stone", [("Person", "Stone")]),
        ("call (212) 555-0123 or +1 (333) 555-9999", [("Phone", "(212) 555-0123"), ("Phone", "+1 (333) 555-9999")]),
        ("", []),
    ],
)
def test_detectors(spark, text, expected):
    assert found(spark, text) == expected


def test_earlier_detectors_win_and_claims_never_overlap(spark):
    text = "SSN 123-45-6789 id 123-45-6789, host 10.1.2.3, passport no: 4111111111111111"
    claims = with_claims(spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")).first()["claims"]
    spans = sorted((c["s"], c["e"]) for c in claims)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert ("Credit Card", "4111111111111111") in [(c["type"], c["value"]) for c in claims]
    assert [c["type"] for c in claims].count("SSN") == 2


def test_null_and_empty_pages_have_no_entities(spark):
    pages = spark.createDataFrame([("a", 1, None), ("b", 1, "")], "doc_id string, page int, text string")
    assert pattern_entities(pages).count() == 0
    assert detect(pages).count() == 0


def test_claimed_needs_every_occurrence(spark):
    rows = spark.createDataFrame([("aXa",), ("aX",), ("b",)], "text string")
    claims = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")))
    assert [r[0] for r in rows.select(is_claimed(F.lit("a"), F.col("text"), claims)).collect()] == [False, True, False]


def test_overlapping_occurrences_and_long_pages(spark):
    rows = spark.createDataFrame([("aaa",), ("a.a.a" + " y" * 60_000,)], "text string")
    assert [[(x["s"], x["e"]) for x in r[0]] for r in rows.select(occurrences(F.when(F.col("text") == "aaa", "aa").otherwise("a.a"), F.col("text"))).collect()] == [[(0, 2), (1, 3)], [(0, 3), (2, 5)]]
    many = spark.createDataFrame([("ab " * 40_000,)], "text string").select(find_spans(F.col("text"), "ab")).first()[0]
    assert [(x["s"], x["e"]) for x in many] == [(3 * k, 3 * k + 2) for k in range(40_000)]
