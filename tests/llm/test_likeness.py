from inkveil.llm import multiset_hash


def likeness(spark, *texts):
    rows = multiset_hash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    lanes = {r["doc_id"]: r["lanes"] for r in rows}
    pair = spark.createDataFrame([(lanes[0], lanes[1])], "a array<long>, b array<long>")
    return pair.select(multiset_hash.likeness("a", "b").alias("x")).first()["x"]


def test_a_word_put_in_front_of_a_line_changes_little(spark):
    text = " ".join(f"w{k}" for k in range(400))
    got = likeness(spark, text, "new " + text)
    print("likeness", got)
    assert got > 0.95


def test_a_piece_repeated_very_often_does_not_wrap(spark):
    got = likeness(spark, "a b\n" * 50000, "a b\n" * 25000)
    assert abs(got - 0.8) < 1e-6


def test_places_hold_all_lanes_that_are_not_zero(spark):
    texts = ["", "\n \n", "a b\n" * 3, " ".join(f"w{k}" for k in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", multiset_hash.placed_lanes_of("text").alias("x"), multiset_hash.lanes_of("text").alias("lanes")).collect()
    for r in rows:
        own = r["x"]["lanes"]
        assert own == r["lanes"] and len(own) == multiset_hash.PLAIN + multiset_hash.LANES
        places = r["x"]["at"]
        assert places == sorted(set(places))
        assert set(places) >= {k for k in range(multiset_hash.PLAIN, len(own)) if own[k]}
        assert all(multiset_hash.PLAIN <= k < len(own) for k in places)
