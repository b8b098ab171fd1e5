from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.functions.text import appears, chunk_words, clean_for_model, find_spans, page_list, removal_sentence, value_key


def column(spark, text, make):
    return spark.createDataFrame([(text,)], "text string").select(make(F.col("text")).alias("x")).first()["x"]


def test_spans_have_offsets_of_code_points(spark):
    found = column(spark, "é1 🙂22", lambda t: find_spans(t, r"\d+"))
    assert [(x["s"], x["e"], x["value"]) for x in found] == [(1, 2, "1"), (4, 6, "22")]
    assert column(spark, "", lambda t: find_spans(t, r"\d+")) == []


def test_captured_value_ends_the_match(spark):
    found = column(spark, "id: 42; id: 7", lambda t: find_spans(t, r"id: (\d+)", 1))
    assert [(x["s"], x["e"], x["value"]) for x in found] == [(4, 6, "42"), (12, 13, "7")]


def test_value_key_makes_white_space_single(spark):
    assert column(spark, "  Jane\t  DOE ", value_key) == "jane doe"


def test_whole_words_only(spark):
    cases = [("Ann", "Ann and Annual", True), ("Ann", "Annual ann_x", False), ("a+b", "so a+b is", True), ("(555) 1", "call (555)\n1 now", True), ("jane doe", "JANE  DOE", True), (" ", "x", False)]
    for value, text, expected in cases:
        assert column(spark, text, lambda t: appears(F.lit(value), t)) is expected, (value, text)


def test_cleaning_drops_noise_and_lowers_capitals(spark):
    text = "JOHN O'NEIL SMITH of USA\nsee https://x.y/z now #tag\n12 34\n1/2/2020 10:11:12 ab L1234567-8"
    assert column(spark, text, clean_for_model) == "John O'neil Smith of USA\nsee  now \n ab "


def test_chunks_cover_all_words(spark):
    words = [f"w{k}" for k in range(430)]
    chunks = column(spark, " ".join(words), chunk_words)
    assert [len(c.split()) for c in chunks] == [200, 200, 90]
    assert column(spark, " \n", chunk_words) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 60), size=st.integers(2, 12), overlap=st.integers(0, 5))
def test_chunks_are_windows(spark, n, size, overlap):
    overlap = min(overlap, size - 1)
    words = [f"w{k}" for k in range(n)]
    expected, i = [], 0
    while i < n:
        expected.append(" ".join(words[i : i + size]))
        if i + size >= n:
            break
        i += size - overlap
    assert column(spark, " ".join(words), lambda t: chunk_words(t, size, overlap)) == expected


def test_lists(spark):
    row = spark.range(1).select(page_list(F.array(F.lit(3))).alias("a"), page_list(F.array(*map(F.lit, (1, 2, 3)))).alias("b"), page_list(F.expr("cast(array() as array<int>)")).alias("c"), removal_sentence(F.array(*map(F.lit, "xyz"))).alias("d"), removal_sentence(F.expr("cast(array() as array<string>)")).alias("e")).first()
    assert tuple(row) == ("Page 3", "Pages 1, 2 and 3", "", "Removed: x, y and z.", "No personal details found.")
