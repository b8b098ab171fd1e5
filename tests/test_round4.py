"""Rows that are dealt before they grow, patterns in one pass, and texts that are not broadcast."""

import random

from pyspark.sql import functions as F

from inkveil.functions import text
from inkveil.functions.fixed import spelled
from inkveil.operators import detectors, model
from inkveil.plans import queries


def test_notes_are_dealt_to_all_cores(spark, folder):
    for make in (queries._notes, lambda *a: queries._sql(*a, queries.derived.CARDS)):
        assert make(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_pattern_finds_what_a_plain_search_does(spark, folder):
    rng = random.Random(3)
    parts = ["May 3, 2020", "3 sept. 1999", "dob: 1990", "born in 1980", "Mr. Ann O'Hara", "SA B. Lee", "plate KX-7", "visa # V-12", "Passport no AB12", "1:21-cr-100-ABC", "12-2020-1234567-QX", "id 9x9", "license: 12ab", "10.0.0.1", "::1:2", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "+49 30 1234", "(212) 555-0100", "a@b.co", "x", "\u0000", "\u0001", "é", "__"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", "", ". "]) for _ in range(20))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").unionByName(queries._notes(spark, folder).select(F.col("page").cast("long").alias("id"), "text"))
    for p in detectors.DETECTORS:
        plain = F.regexp_extract_all("text", F.lit(spelled(p.regex)), F.lit(p.group))
        own = F.transform(text.find_spans(F.col("text"), p.java, p.group), lambda x: x["value"])
        need = F.contains("text", F.lit(p.need)) | (F.size(plain) == 0)
        got = df.select(F.count_if(~own.eqNullSafe(plain)).alias("bad"), F.count_if(~need).alias("lost"), F.sum(F.size(plain)).alias("n")).first()
        assert got["bad"] == 0 and got["lost"] == 0 and got["n"] > 0, p


def test_texts_that_are_put_together_are_not_broadcast(spark, folder):
    notes = queries._notes(spark, folder)
    claims = detectors.with_claims(notes).select("doc_id", "page", "claims")
    for df in (queries.instruction_hits(spark, folder), model.filter_entities(queries._tagged_people(spark, folder), notes, claims)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_name_is_taken_from_its_text_once(spark, folder):
    notes = queries._notes(spark, folder)
    claims = detectors.with_claims(notes).select("doc_id", "page", "claims")
    df = model.filter_entities(queries._tagged_people(spark, folder), notes, claims)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(word") <= 10


def test_claims_are_made_once(spark, folder):
    df = queries.claimed_values(spark, folder)
    assert "luhn" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lanes_are_the_counts_of_slots(spark):
    from inkveil.llm import multiset_hash as m

    rng = random.Random(5)
    rows = [(k, [f"p{rng.randrange(40) if k % 2 else rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 7, 9000]))]) for k in range(12)]
    df = spark.createDataFrame(rows, "k long, p array<string>")
    slots = F.expr(f"transform(p, x -> cast(pmod(xxhash64(x), {2 * m.LANES}) as int))")
    for r in df.select(slots.alias("s"), F.expr(m.signed_lanes("p")).alias("got")).collect():
        want = [0] * m.LANES
        for x in r["s"]:
            want[x // 2] += 1 - 2 * (x % 2)
        assert r["got"] == want
    # No mark for each slot is sorted with them.
    assert f"sequence(0, {4 * m.LANES}" not in m.signed_lanes("p")
