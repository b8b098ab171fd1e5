"""Redaction: the union of all spans of a page, taken out of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import find_spans, let, running, word_pattern, words_of

BLOCK = "█"


def span_union(matches: DataFrame) -> DataFrame:
    """(doc_id, page, s, e) of disjoint stretches, from matches with `spans` on the original text."""
    rows = matches.select("doc_id", "page", F.explode("spans").alias("x")).select("doc_id", "page", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    page = Window.partitionBy("doc_id", "page").orderBy("s", "e")
    before = F.max("e").over(page.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("s") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("doc_id", "page", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


#: Characters of a text that are put together at once, so that no long text is walked from its start
#: for every span.
_STRETCH = 4096


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text without its spans, an array of (s, e) in order that don't overlap."""

    def hidden(x: Column, at: Column, low: Column) -> Column:
        if mask == "block":
            return F.repeat(F.lit(BLOCK), F.least(x["e"] - low, F.lit(_STRETCH)) - at)
        return F.lit("") if mask == "drop" else F.when(x["s"] >= low, F.lit(mask)).otherwise("")

    def stretch(k: Column) -> Column:
        low = k * _STRETCH
        part = F.substring(text, low + 1, F.lit(_STRETCH))

        def put(own: Column) -> Column:
            ends = F.concat(F.array(F.lit(0)), F.transform(own, lambda x: F.least(x["e"] - low, F.lit(_STRETCH))))
            start = lambda x: F.greatest(x["s"] - low, F.lit(0))
            pieces = F.zip_with(own, F.slice(ends, F.lit(1), F.size(own)), lambda x, at: F.concat(F.substring(part, at + 1, start(x) - at), hidden(x, start(x), low)))
            return F.concat(F.array_join(pieces, ""), F.substring(part, F.element_at(ends, -1) + 1, F.lit(_STRETCH)))

        return let(F.filter(spans, lambda x: (x["s"] < low + _STRETCH) & (x["e"] > low)), put)

    last = F.greatest(F.ceil(F.length(text) / F.lit(float(_STRETCH))) - 1, F.lit(0)).cast("int")
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), last), stretch), ""))


def islands(spans: Column) -> Column:
    """The union of an array of spans (s, e): disjoint stretches in order. Spans that touch are one."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def of(own: Column) -> Column:
        ends = running(F.transform(own, lambda x: x["e"]), lambda a, b: F.greatest(a, b))

        def cut(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(1), F.size(own)), lambda k: (k == 1) | (F.element_at(own, k)["s"] > F.element_at(ends, F.greatest(k - 1, F.lit(1)))))
            last = lambda first: F.concat(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda k: k - 1), F.array(F.size(own)))
            return let(first, lambda first: F.zip_with(first, last(first), lambda a, b: F.struct(F.element_at(own, a)["s"].alias("s"), F.element_at(ends, b).alias("e"))))

        return let(ends, cut)

    return F.when(F.size(spans) == 0, none).otherwise(let(F.array_sort(spans), of))


def spans_of(values: Column, text: Column) -> Column:
    """Where any of an array of values stands in the text as a whole word: disjoint (s, e), in order."""

    def places(v: Column, lower: Column) -> Column:
        first = F.lower(F.try_element_at(words_of(v), F.lit(1)))
        found = F.transform(find_spans(text, word_pattern(v)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.when(F.coalesce(F.contains(lower, first), F.lit(False)), found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

    return let(let(F.lower(text), lambda lower: F.flatten(F.transform(values, lambda v: places(v, lower)))), islands)


def spans_in(pages: DataFrame, values: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) plus _spans: where any value (doc_id, value) of the page's document stands.

    The pages meet the values of their document as one array, so texts are read and moved once. This is for
    documents of few pages; for those of many, redact_text() of what locate(by_word=True) finds.
    """
    own = values.where("value is not null").groupBy("doc_id").agg(F.collect_set("value").alias("_values"))
    spans = F.when(F.col("_values").isNull(), F.array().cast("array<struct<s:int,e:int>>")).otherwise(spans_of(F.col("_values"), F.coalesce(F.col("text"), F.lit(""))))
    return pages.join(own, "doc_id", "left").select(*pages.columns, spans.alias("_spans"))


def redact_spans(pages: DataFrame, mask: str = "block") -> DataFrame:
    """pages of spans_in() plus n_redacted and redacted_text, without _spans. Works row by row."""
    done = let(F.col("_spans"), lambda x: F.struct(F.size(x).alias("n"), masked(F.coalesce(F.col("text"), F.lit("")), x, mask).alias("t")))
    return pages.withColumn("_done", done).select(*[c for c in pages.columns if c != "_spans"], F.col("_done.n").alias("n_redacted"), F.col("_done.t").alias("redacted_text"))


def redact_values(pages: DataFrame, values: DataFrame, mask: str = "block") -> DataFrame:
    """pages (doc_id, page, text) plus n_redacted and redacted_text: every value (doc_id, value) of the page's
    document, wherever it stands. For documents of few pages, see spans_in()."""
    return redact_spans(spans_in(pages, values), mask)


def redact_text(pages: DataFrame, spans: DataFrame, mask: str = "block") -> DataFrame:
    """pages (doc_id, page, text) plus n_redacted and redacted_text. Pages without spans stay.

    `mask` is "block" (as many blocks, so offsets stay), "drop", or any text to put instead.
    """
    own = spans.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int>>")
    rows = pages.join(own, ["doc_id", "page"], "left").withColumn("spans", F.coalesce("spans", none))
    return rows.withColumn("n_redacted", F.size("spans")).withColumn("redacted_text", masked(text, F.col("spans"), mask)).drop("spans")
