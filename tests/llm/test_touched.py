from pyspark.sql import functions as F

from inkveil.llm import multiset_hash as m

TEXTS = ["", " \n\t", "one", "a b\n" * 500, "b a\na b", " ".join(f"w{k}" for k in range(900)), "\n".join(f"x{k} y{k % 7} z" for k in range(4000)), "Straße  é x\ty"]


def test_touched_lanes_say_what_all_lanes_say(spark):
    """Fingerprints and likeness made of the lanes that pieces touch, against those made of all lanes."""
    rows = spark.createDataFrame([(x, y) for x in TEXTS for y in TEXTS], "x string, y string")
    rows = rows.select(*[F.expr(m.touched_lanes_of(c)).alias(f"{c}_own") for c in "xy"], *[m.lanes_of(c).alias(f"{c}_all") for c in "xy"])
    squares = [F.expr(f"aggregate({c}_own.s.v, 0D, (acc, v) -> acc + cast(v as double) * v)").alias(f"{c}_own_squares") for c in "xy"]
    rows = rows.select("*", *squares, F.expr(m.signed_array("x_own.s")).alias("signed"))
    got = rows.select(m.touched_as_text("x_own").alias("text"), m.as_text("x_all").alias("want_text"), m.touched_likeness("x_own", "y_own", "signed").alias("near"), m.likeness("x_all", "y_all").alias("want_near"))
    for r in got.collect():
        assert r["text"] == r["want_text"] and r["text"].count(",") == m.PLAIN + m.LANES - 1
        assert r["near"] == r["want_near"]


def test_compared_makes_one_array_of_all_lanes(spark):
    """Of the three texts of a row only one has its lanes as an array; the others have those that pieces touch."""
    plan = m.compared(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_repeat") <= 4
