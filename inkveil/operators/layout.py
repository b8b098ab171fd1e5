"""Pages from layout: reading order of lines, page statistics, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import fixed
from inkveil.functions.text import trimmed


def page_text(lines: DataFrame, tolerance: float = fixed.ROW_TOLERANCE) -> DataFrame:
    """(doc_id, page, text) from layout lines (doc_id, page, ord, x, y, text).

    In their order, lines join the first row whose anchor is within the tolerance, else start a
    row. Rows come by anchor, their lines by x. A row can only take in lines of its own stretch of
    the page, which ends where the next line is further away than the tolerance; so lines meet the
    few anchors of their stretch, however many the page has. All steps keep one dealing by page.
    """
    clean = trimmed(F.regexp_replace("text", "�+", ""))
    rows = lines.select("doc_id", "page", "ord", "x", F.col("y").cast("double").alias("y"), clean.alias("text")).where("text <> ''")
    down = Window.partitionBy("doc_id", "page").orderBy("y")
    starts = F.coalesce(F.col("y") - F.lag("y").over(down) > tolerance, F.lit(True)).cast("int")
    rows = rows.withColumn("_starts", starts).withColumn("_stretch", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = rows.groupBy("doc_id", "page", "_stretch").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "text"))).alias("items"))
    near = lambda a, i: F.abs(a - i["y"]) <= tolerance
    anchors = F.aggregate("items", F.array().cast("array<double>"), lambda acc, i: F.when(F.exists(acc, lambda a: near(a, i)), acc).otherwise(F.concat(acc, F.array(i["y"]))))
    placed = F.transform("items", lambda i: F.struct(F.element_at(F.filter("anchors", lambda a: near(a, i)), 1).alias("a"), i["x"].alias("x"), i["ord"].alias("ord"), i["text"].alias("text")))
    rows = own.withColumn("anchors", anchors).select("doc_id", "page", F.inline(placed))
    joined = lambda of, by, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, of))), lambda x: x[of]), sep)
    rows = rows.groupBy("doc_id", "page", "a").agg(joined("text", ["x", "ord"], " ").alias("line"))
    return rows.groupBy("doc_id", "page").agg(joined("line", ["a"], "\n").alias("text"))


def letters_and_digits(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]")).cast("long")


def _bounded(images: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """images with the page's bounds px0, py0, px1, py1: given (doc_id, page, x0, y0, x1, y1) or,
    where a page has none, those of a letter page."""
    letter = dict(zip(("px0", "py0", "px1", "py1"), (0.0, 0.0, *fixed.LETTER_PAGE)))
    if bounds is None:
        return images.withColumns({k: F.lit(v) for k, v in letter.items()})
    own = bounds.select("doc_id", "page", *[F.col(k[1:]).cast("double").alias(k) for k in letter])
    return images.join(own, ["doc_id", "page"], "left").fillna(letter)


def page_stats(pages: DataFrame, images: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, char_count, image_coverage, has_text, scanned) of every page.

    images: doc_id, page, x0, y0, x1, y1; clipped to the page's bounds (the same columns; a letter
    page where there are none). Scanned pages have text over an image that covers nine tenths.
    """
    rows = pages.select("doc_id", "page", letters_and_digits(F.col("text")).alias("char_count"))
    if images is None:
        rows = rows.withColumn("area", F.lit(0.0)).withColumn("largest", F.lit(0.0))
    else:
        wide = F.greatest(F.least("x1", "px1") - F.greatest("x0", "px0"), F.lit(0.0))
        high = F.greatest(F.least("y1", "py1") - F.greatest("y0", "py0"), F.lit(0.0))
        whole = (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))
        area = _bounded(images, bounds).withColumn("share", F.when(whole > 0, wide * high / whole).otherwise(0.0)).groupBy("doc_id", "page").agg(F.sum("share").alias("area"), F.max("share").alias("largest"))
        rows = rows.join(area, ["doc_id", "page"], "left").fillna(0.0, ["area", "largest"])
    has = F.col("char_count") >= fixed.MIN_PAGE_CHARS
    return rows.select("doc_id", "page", "char_count", F.least("area", F.lit(1.0)).alias("image_coverage"), has.alias("has_text"), (has & (F.col("largest") >= fixed.FULL_PAGE)).alias("scanned"))


def documents_with_text(stats: DataFrame) -> DataFrame:
    """doc_id of the documents with text on any page."""
    return stats.groupBy("doc_id").agg(F.bool_or("has_text").alias("any")).where("any").select("doc_id")


def _listed(stats: DataFrame, which: Column) -> DataFrame:
    return stats.where(which).groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def image_only_pages(stats: DataFrame) -> DataFrame:
    return _listed(stats, ~F.col("has_text") & (F.col("image_coverage") >= fixed.IMAGE_COVERAGE))


def scanned_pages(stats: DataFrame) -> DataFrame:
    return _listed(stats, F.col("scanned"))


def image_inventory(images: DataFrame, pages: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, idx, id, full_page, big, covers, text_layer) of the images worth a review.

    A page with an image that covers it under a text layer lists none; other pages list big ones.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    layer = pages.select("doc_id", "page", (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) >= fixed.MIN_PAGE_CHARS).alias("text_layer"))
    whole = (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))
    rows = _bounded(images, bounds).withColumn("big", F.greatest(w, h) >= fixed.BIG_IMAGE).withColumn("covers", (whole > 0) & (w * h >= fixed.FULL_PAGE * whole))
    rows = rows.join(layer, ["doc_id", "page"], "left").withColumn("text_layer", F.coalesce("text_layer", F.lit(False)))
    hidden = F.bool_or(F.col("covers") & F.col("text_layer")).over(Window.partitionBy("doc_id", "page"))
    rows = rows.withColumn("hidden", hidden).where("big and not hidden")
    return rows.select("doc_id", "page", "idx", F.concat_ws(":", "page", "idx").alias("id"), (F.col("covers") & ~F.col("text_layer")).alias("full_page"), "big", "covers", "text_layer")


def remove_image_pages(pages: DataFrame, inventory: DataFrame, selected: DataFrame) -> DataFrame:
    """(doc_id, page, kept, error): pages go whose selected image (doc_id, id) fills them.

    A document that would lose all its pages keeps them, and has an error instead.
    """
    gone = inventory.where("full_page").join(selected.select("doc_id", "id"), ["doc_id", "id"], "left_semi").select("doc_id", "page").distinct().withColumn("gone", F.lit(True))
    rows = pages.select("doc_id", "page").join(gone, ["doc_id", "page"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    every = F.bool_and("gone").over(Window.partitionBy("doc_id"))
    return rows.withColumn("error", every).select("doc_id", "page", (~F.col("gone") | F.col("error")).alias("kept"), "error")
