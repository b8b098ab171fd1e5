"""How well redaction worked: expected values still readable, detected values not expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import appears, value_key
from inkveil.sources.scratch import written


def _grams(value: Column) -> Column:
    """All stretches of one to three characters of a value, each once."""
    cuts = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - k + 1, F.lit(1))), lambda at: F.substring(value, at, F.lit(k))) for k in (1, 2, 3)]
    return F.array_distinct(F.concat(*cuts))


def _start(value: Column) -> Column:
    return F.left(value, F.lit(3))


def unlike(found: DataFrame, want: DataFrame) -> DataFrame:
    """The rows of found (doc_id, d) that neither hold nor are held by any value of want (doc_id, v) of their
    document. A value that is held shares its first three characters with what holds it, so the two meet by these."""
    found, want = found.where("d <> ''"), want.where("v <> ''").select("doc_id", "v").distinct()
    around = want.select("doc_id", "v", F.explode(_grams(F.col("v"))).alias("g"))
    within = found.select("doc_id", "d", F.explode(_grams(F.col("d"))).alias("g")).join(want.withColumn("g", _start(F.col("v"))).hint("merge"), ["doc_id", "g"]).where(F.contains("d", F.col("v")))
    rows = found.withColumn("g", _start(F.col("d"))).alias("f")
    held = (F.col("f.doc_id") == F.col("w.doc_id")) & (F.col("f.g") == F.col("w.g")) & F.contains(F.col("w.v"), F.col("f.d"))
    # Merged: what is exploded is far larger than the optimizer takes it for, and must not be broadcast.
    rows = rows.join(around.alias("w").hint("merge"), held, "left_anti").select("f.doc_id", "f.d")
    return rows.join(within.select("doc_id", "d").distinct(), ["doc_id", "d"], "left_anti")


def judged(expected: DataFrame, detected: DataFrame, redacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, wrong) of each document of `redacted` (doc_id, page, text, redacted_text) or of the values.

    rows: doc_id, want (v, type, missed) and found (d, type) of expected and detected (doc_id, value, type).
    wrong: doc_id, d of the found values unlike all expected ones. A document's values meet its texts as
    arrays, in one row; what comes of it is written, so texts are read once.
    """
    # A null value keeps its document, and adds nothing to the array.
    want = F.when(F.col("value").isNotNull(), F.struct(value_key(F.col("value")).alias("v"), "type"))
    dets = detected.select("doc_id", value_key(F.col("value")).alias("d"), "type").groupBy("doc_id", "d").agg(F.min("type").alias("type"))
    own = expected.select("doc_id", want.alias("w"), F.lit(None).cast("struct<d:string,type:string>").alias("x"))
    own = own.unionByName(dets.select("doc_id", F.lit(None).cast("struct<v:string,type:string>").alias("w"), F.struct("d", "type").alias("x")))
    own = own.groupBy("doc_id").agg(F.collect_list("w").alias("want"), F.collect_list("x").alias("dets"))
    pages = redacted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("redacted_text", F.lit("")).alias("r")))).alias("p"))
    whole = pages.select("doc_id", *[F.array_join(F.transform("p", lambda x: x[c]), "\n").alias(c) for c in ("t", "r")])
    rows = whole.join(own, "doc_id", "full_outer").withColumns({"t": F.coalesce("t", F.lit("")), "r": F.coalesce("r", F.lit(""))})
    missed = F.transform(F.coalesce("want", F.array().cast("array<struct<v:string,type:string>>")), lambda w: F.struct(w["v"].alias("v"), w["type"].alias("type"), appears(w["v"], F.col("r")).alias("missed")))
    found = F.filter(F.coalesce("dets", F.array().cast("array<struct<d:string,type:string>>")), lambda x: appears(x["d"], F.col("t")))
    rows = written(rows.select("doc_id", missed.alias("want"), found.alias("found")), "judged")
    return rows, unlike(rows.select("doc_id", F.inline("found")).select("doc_id", "d"), rows.select("doc_id", F.inline("want")).select("doc_id", "v"))


def _typed(rows: DataFrame) -> DataFrame:
    return rows if "type" in rows.columns else rows.withColumn("type", F.lit(None).cast("string"))


def evaluate_documents(expected: DataFrame, detected: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row for each document of `redacted` (doc_id, page, text, redacted_text) or `expected` (doc_id, value).

    Missed: expected values, repeats counted, that still stand in the redacted text as whole
    words. Detected: distinct approved values (doc_id, value) that stand in the original. A false
    positive neither holds nor is held by any expected value. Pages are joined by line ends.
    """
    rows, wrong = judged(_typed(expected), _typed(detected), redacted)
    n_wrong = wrong.groupBy("doc_id").agg(F.count("*").alias("n_false"))
    n = {"n_expected": F.size("want"), "n_missed": F.size(F.filter("want", lambda w: w["missed"])), "n_detected": F.size("found")}
    rows = rows.select("doc_id", *[c.cast("long").alias(k) for k, c in n.items()]).join(n_wrong, "doc_id", "left").fillna(0, ["n_false"])
    return rows.select("doc_id", "n_expected", "n_missed", _caught().alias("catch_rate"), "n_detected", "n_false", _ratio(F.col("n_false"), F.col("n_detected")).alias("false_positive_rate"))


def evaluate_rollup(expected: DataFrame, detected: DataFrame, redacted: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals over grouping sets: each source and type, each source, each type, and all.

    expected and detected: doc_id, value, type; sources: doc_id, source. `level` says what a row is a total over (0
    neither, 1 types, 2 sources, 3 both), so a null source or type of its own is told from a total.
    """
    rows, wrong = judged(expected, detected, redacted)
    bad = wrong.withColumn("bad", F.lit(True))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    want = rows.select("doc_id", F.inline("want")).select("doc_id", "type", one.alias("n_expected"), F.col("missed").cast("long").alias("n_missed"), none.alias("n_detected"), none.alias("n_false"))
    found = rows.select("doc_id", F.inline("found")).join(bad, ["doc_id", "d"], "left").select("doc_id", "type", none.alias("n_expected"), none.alias("n_missed"), one.alias("n_detected"), F.coalesce("bad", F.lit(False)).cast("long").alias("n_false"))
    own = want.unionByName(found).join(sources.select("doc_id", "source"), "doc_id", "left")
    names = ["n_expected", "n_missed", "n_detected", "n_false"]
    total = own.cube("source", "type").agg(F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in names])
    return total.select("source", "type", "level", *names, _caught().alias("catch_rate"), _ratio(F.col("n_false"), F.col("n_detected")).alias("false_positive_rate"))


def _caught() -> Column:
    return _ratio(F.col("n_expected") - F.col("n_missed"), F.col("n_expected"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def evaluate_corpus(documents: DataFrame) -> DataFrame:
    """Totals over all documents; the ratios are of the totals."""
    names = ["n_expected", "n_missed", "n_detected", "n_false"]
    total = documents.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return total.withColumn("catch_rate", _ratio(F.col("n_expected") - F.col("n_missed"), F.col("n_expected"))).withColumn("false_positive_rate", _ratio(F.col("n_false"), F.col("n_detected")))


def run_flags(replies: DataFrame) -> DataFrame:
    """(doc_id, pages, incomplete, failed, model_used, fell_back) of assembled replies: pages that
    didn't stop by themselves, whether any page ended in an error, whether the model said anything,
    and whether the document has to fall back, as it said nothing and failed."""
    stopped = F.coalesce(F.col("stop_reason") == "stop", F.lit(False))
    own = replies.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(~stopped).alias("incomplete"), F.bool_or(F.col("error").isNotNull()).alias("failed"), F.bool_or(F.coalesce("content", F.lit("")) != "").alias("model_used"))
    return own.withColumn("fell_back", F.col("failed") & ~F.col("model_used"))
