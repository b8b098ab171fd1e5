"""Entities of a document: first-seen values, thresholds, surnames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import fixed
from inkveil.functions.text import value_key, words_of
from inkveil.sources.scratch import written


def numbered(rows: DataFrame, order: list[str], name: str = "ord", by: str = "doc_id") -> DataFrame:
    """rows plus `name`: 1, 2, ... within each value of `by`, in order.

    The rows are sorted into ranges, and counted by range; a row's number is its place in the range plus
    what the ranges before hold. So a document with a third of all rows is numbered by many tasks.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(ranges, by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    out = ranged.withColumn("_place", place).join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return out.select(*[c for c in rows.columns if c != name], (F.col("_place") + F.col("_before")).cast("long").alias(name))


def first_seen(entities: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each value of a document, by `order`; adds value_key and ord.

    Only the few columns of entities cross the shuffle, never page texts, and of a value that is seen
    very often each task hands on one row.
    """
    keyed = entities.withColumn("value_key", value_key(F.col("value")))
    rest = [c for c in keyed.columns if c not in ("doc_id", "value_key")]
    first = keyed.groupBy("doc_id", "value_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    kept = first.select(*[F.col(c) if c in ("doc_id", "value_key") else F.col(f"_x.{c}").alias(c) for c in keyed.columns])
    return numbered(kept, order)


def spread_surnames(entities: DataFrame) -> DataFrame:
    """Adds the surname of every person of two or more words that isn't an entity yet.

    entities: doc_id, type, value, value_key, page, approved, ord. The new rows follow the others,
    and are like the first person of that surname. The entities are written once and read from there.
    """
    entities = written(entities, "entities")
    words = F.filter(words_of(F.regexp_replace("value", ",", " ")), lambda w: ~F.regexp_like(w, F.lit(fixed.NAME_SUFFIXES)))
    # A trailing comma leaves an empty last word, and no surname.
    open_end = F.regexp_like("value", F.lit(r"[,\s]$"))
    last = F.when((F.col("type") == "Person") & ~open_end & (F.size(words) >= 2), F.regexp_replace(F.try_element_at(words, F.lit(-1)), r"[^\p{L}'’-]", ""))
    surname = F.when((F.length(last) >= 3) & F.regexp_like(last, F.lit(r"^\p{Lu}")), last)
    added = entities.withColumn("value", surname).where("value is not null").withColumn("value_key", value_key(F.col("value")))
    rest = [c for c in entities.columns if c not in ("doc_id", "value_key")]
    added = added.groupBy("doc_id", "value_key").agg(F.min_by(F.struct(*rest), "ord").alias("_x")).select("doc_id", "value_key", "_x.*")
    added = added.join(entities.select("doc_id", "value_key"), ["doc_id", "value_key"], "left_anti").select(*entities.columns)
    added = numbered(added, ["ord"], "_new")
    top = entities.groupBy("doc_id").agg(F.max("ord").alias("_top"))
    added = added.join(top, "doc_id").withColumn("ord", (F.col("_top") + F.col("_new")).cast("long"))
    return entities.unionByName(added.select(*entities.columns))
