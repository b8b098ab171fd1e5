"""Detection, redaction and counting on streams of pages (doc_id, page, text, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import value_key
from inkveil.operators.detectors import DETECTORS, Pattern, with_claims
from inkveil.plans.pipeline import redact_known


def stream_redacted(pages: DataFrame, mask: str = "block") -> DataFrame:
    """Each page with its own matches redacted; stateless."""
    return redact_known(pages, mask=mask)


def stream_entities(pages: DataFrame, delay: str = "10 minutes", patterns: list[Pattern] | None = None) -> DataFrame:
    """Each value of a document once within the watermark: the first to arrive, not the first page."""
    found = with_claims(pages.withWatermark("ts", delay), DETECTORS if patterns is None else patterns)
    rows = found.select("doc_id", "page", "ts", F.inline("claims")).where("type is not null").withColumn("value_key", value_key(F.col("value")))
    return rows.dropDuplicatesWithinWatermark(["doc_id", "value_key"]).select("doc_id", "page", "ts", "type", "value", "value_key")


def stream_match_totals(pages: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Matches of each type by window of arrival."""
    found = with_claims(pages.withWatermark("ts", delay)).select("ts", F.inline("claims")).where("type is not null")
    return found.groupBy(F.window("ts", window).alias("w"), "type").agg(F.count("*").alias("n")).select("w.start", "w.end", "type", "n")
