"""Review of entities: groups, lists, decisions, custom values, pending changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import trimmed, value_key
from inkveil.operators.entities import numbered


def group_entities(entities: DataFrame) -> DataFrame:
    """(doc_id, value_key, type, value, approved, source, first_page, group_order).

    Of each value the first row's columns, its smallest page, and its place in the document by
    page and then by first appearance.
    """
    first = F.min_by(F.struct("type", "value", "approved", "source"), "ord")
    own = entities.groupBy("doc_id", "value_key").agg(first.alias("f"), F.min("page").alias("first_page"), F.min("ord").alias("ord"))
    own = numbered(own.select("doc_id", "value_key", "f.type", "f.value", "f.approved", "f.source", "first_page", "ord"), ["first_page", "ord"], "group_order")
    return own.drop("ord")


def review_list(groups: DataFrame, summary: DataFrame) -> DataFrame:
    """(doc_id, category_order, item_order, type, value, approved, pages, count).

    Groups without matches go. Items come by first matched page; categories as they appear, Custom
    first (its newest item first) and Miscellaneous last.
    """
    rows = groups.join(summary, ["doc_id", "value"]).where("count > 0").withColumn("first", F.element_at("pages", 1))
    doc = Window.partitionBy("doc_id").orderBy("first", "group_order")
    rows = rows.withColumn("place", F.row_number().over(doc))
    lead = F.min("place").over(Window.partitionBy("doc_id", "type"))
    rank = F.when(F.col("type") == "Custom", -1).when(F.col("type") == "Miscellaneous", 1 << 30).otherwise(lead)
    rows = rows.withColumn("rank", rank)
    rows = rows.withColumn("category_order", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("rank")))
    within = F.when(F.col("type") == "Custom", -F.col("group_order")).otherwise(F.col("place").cast("long"))
    rows = rows.withColumn("item_order", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy(within)))
    return rows.select("doc_id", "category_order", "item_order", "type", "value", "approved", "pages", "count")


def category_rollup(groups: DataFrame) -> DataFrame:
    """(doc_id, type, n, n_approved, state): all, none or mixed."""
    own = groups.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count_if("approved").alias("n_approved"))
    state = F.when(F.col("n_approved") == F.col("n"), "all").when(F.col("n_approved") == 0, "none").otherwise("mixed")
    return own.withColumn("state", state)


def apply_decisions(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """`approved` as decided (doc_id, value_key, approved); of repeated decisions all must approve."""
    own = decisions.groupBy("doc_id", "value_key").agg(F.bool_and("approved").alias("decided"))
    rows = entities.join(own, ["doc_id", "value_key"], "left")
    return rows.withColumn("approved", F.coalesce("decided", "approved")).select(*entities.columns)


def add_custom(entities: DataFrame, custom: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds custom values (doc_id, value) of 2 characters or more that match somewhere, on their
    first matching page; values that are entities already are approved instead.

    matches: doc_id, value, page of the custom values.
    """
    rows = custom.select("doc_id", F.regexp_replace(trimmed(F.col("value")), r"\s+", " ").alias("value")).where(F.length("value") >= 2)
    rows = rows.withColumn("value_key", value_key(F.col("value"))).groupBy("doc_id", "value_key").agg(F.min("value").alias("value"))
    where = matches.withColumn("value_key", value_key(F.col("value"))).groupBy("doc_id", "value_key").agg(F.min("page").alias("page"))
    rows = rows.join(where, ["doc_id", "value_key"])
    listed = entities.join(rows.select("doc_id", "value_key", F.lit(True).alias("again")), ["doc_id", "value_key"], "left")
    listed = listed.withColumn("approved", F.coalesce("again", "approved")).select(*entities.columns)
    top = entities.groupBy("doc_id").agg(F.max("ord").alias("top"))
    new = rows.join(entities.select("doc_id", "value_key"), ["doc_id", "value_key"], "left_anti").join(top, "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("value_key"))
    new = new.withColumn("ord", (F.coalesce("top", F.lit(0)) + place).cast("long")).withColumns({"type": F.lit("Custom"), "approved": F.lit(True), "source": F.lit(None).cast("string")})
    extra = [c for c in entities.columns if c not in new.columns]
    kinds = dict(entities.dtypes)
    return listed.unionByName(new.withColumns({c: F.lit(None).cast(kinds[c]) for c in extra}).select(*entities.columns))


def remove_custom(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the Custom rows of these values (doc_id, value_key); other rows stay."""
    gone = keys.select("doc_id", "value_key").distinct().withColumn("type", F.lit("Custom"))
    return entities.join(gone, ["doc_id", "value_key", "type"], "left_anti").select(*entities.columns)


def classify_hits(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, value_key, value, action) of hits (doc_id, value): approve an entity that isn't,
    skip one that is, or add a Custom one."""
    own = hits.withColumn("value_key", value_key(F.col("value"))).groupBy("doc_id", "value_key").agg(F.min("value").alias("value"))
    known = entities.groupBy("doc_id", "value_key").agg(F.bool_and("approved").alias("approved"))
    rows = own.join(known, ["doc_id", "value_key"], "left")
    action = F.when(F.col("approved").isNull(), "add").when(F.col("approved"), "skip").otherwise("approve")
    return rows.select("doc_id", "value_key", "value", action.alias("action"))


def merge_hits(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """entities with the hits (doc_id, page, value) of an instruction: values that are entities are
    approved, others are added as Custom with source `ai`, each on its first page."""
    own = hits.withColumn("value_key", value_key(F.col("value"))).groupBy("doc_id", "value_key").agg(F.min_by("value", F.struct("page", "value")).alias("value"), F.min("page").alias("page"))
    known = own.select("doc_id", "value_key", F.lit(True).alias("again"))
    listed = entities.join(known, ["doc_id", "value_key"], "left").withColumn("approved", F.coalesce("again", "approved")).select(*entities.columns)
    top = entities.groupBy("doc_id").agg(F.max("ord").alias("top"))
    new = own.join(entities.select("doc_id", "value_key"), ["doc_id", "value_key"], "left_anti").join(top, "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "value_key"))
    new = new.withColumns({"ord": (F.coalesce("top", F.lit(0)) + place).cast("long"), "type": F.lit("Custom"), "approved": F.lit(True), "source": F.lit("ai")})
    kinds = dict(entities.dtypes)
    new = new.withColumns({c: F.lit(None).cast(kinds[c]) for c in entities.columns if c not in new.columns})
    return listed.unionByName(new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in entities.columns]))


def changed_by_hits(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, changes): how many values merge_hits() approves or adds."""
    own = classify_hits(entities, hits).groupBy("doc_id").agg(F.count_if(F.col("action") != "skip").alias("changes"))
    return own


def unapplied_changes(old: DataFrame, new: DataFrame, old_ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(doc_id, changed): entities (doc_id, ord, value, approved) compared place by place, and the
    selected images or kept links (doc_id, id) compared as sets."""
    left, right = (x.select("doc_id", "ord", F.col("value").alias(f"v{k}"), F.col("approved").alias(f"a{k}")) for k, x in enumerate((old, new)))
    differ = ~(F.col("v0").eqNullSafe(F.col("v1")) & F.col("a0").eqNullSafe(F.col("a1")))
    own = left.join(right, ["doc_id", "ord"], "full_outer").groupBy("doc_id").agg(F.bool_or(differ).alias("changed"))
    a, b = old_ids.select("doc_id", "id").distinct(), new_ids.select("doc_id", "id").distinct()
    ids = a.exceptAll(b).unionByName(b.exceptAll(a)).select("doc_id").distinct().withColumn("ids", F.lit(True))
    rows = own.join(ids, "doc_id", "full_outer")
    return rows.select("doc_id", (F.coalesce("changed", F.lit(False)) | F.coalesce("ids", F.lit(False))).alias("changed"))
