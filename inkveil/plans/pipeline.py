"""The whole dataflow: detect, locate, redact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators.detectors import DETECTORS, Pattern, claimed_rows, claims_table, with_claims
from inkveil.operators.entities import first_seen, spread_surnames
from inkveil.operators.layout import remove_image_pages
from inkveil.operators.locate import locate
from inkveil.operators.model import approve_reply, assemble_replies, dedupe_reply, filter_entities, map_label, reply_entities, with_reasons
from inkveil.operators.redact import masked, redact_text, redact_values, span_union
from inkveil.operators.review import add_custom, apply_decisions, group_entities, merge_hits
from inkveil.sources.scratch import written

ORDER = ["page", "src", "rank", "pat", "s"]
COLUMNS = ["doc_id", "type", "value", "value_key", "page", "approved", "source", "ord"]


def detect(pages: DataFrame, model_entities: DataFrame | None = None, patterns: list[Pattern] | None = None, surnames: bool = True, overrides: dict[str, float] | None = None) -> DataFrame:
    """Entities of every document: patterns first, then a tagger's, each value once.

    `model_entities` are grouped tokens; None leaves the tagger out, an empty list of patterns
    leaves the patterns out. The pages are searched once, into a table of claims in the shared folder.
    """
    claims = claims_table(pages, DETECTORS if patterns is None else patterns)
    found = pages.select("doc_id", "page", F.lit(None).cast("string").alias("type"), F.lit("").alias("value"), F.lit(0).alias("src"), F.lit(0).alias("rank"), F.lit(0).alias("pat"), F.lit(0).alias("s")).where("false")
    if patterns is None or patterns:
        found = claimed_rows(claims).select("doc_id", "page", "type", "value", F.lit(0).alias("src"), "rank", "pat", "s")
    if model_entities is not None:
        own = filter_entities(model_entities, pages, claims, overrides)
        found = found.unionByName(own.select("doc_id", "page", "type", "value", F.lit(1).alias("src"), F.col("chunk").cast("int").alias("rank"), F.lit(0).alias("pat"), F.col("grp").alias("s")))
    rows = first_seen(found, ORDER).withColumn("approved", F.lit(True)).withColumn("source", F.lit(None).cast("string")).select(*COLUMNS)
    return spread_surnames(rows) if surnames else rows


def detect_chat(pages: DataFrame, replies: DataFrame, patterns: list[Pattern] | None = None, surnames: bool = True) -> DataFrame:
    """Entities of every document: patterns first, then what a chat model replied to each page.

    replies: streamed lines (doc_id, page, seq, line). They are put together, their objects
    salvaged up to a repeat loop, rejected for the first reason that applies, named by type and
    left out where a pattern has claimed them. Miscellaneous ones aren't approved. What was salvaged, and
    what is left of it, is written: each is used twice, and would be made anew each time.
    """
    claims = claims_table(pages, DETECTORS if patterns is None else patterns)
    found = claimed_rows(claims)
    found = found.select("doc_id", "page", "type", "value", F.lit(True).alias("approved"), F.lit(0).alias("src"), "rank", "pat", "s")
    salvaged = written(reply_entities(assemble_replies(replies)), "salvaged")
    listed = with_reasons(written(dedupe_reply(salvaged), "listed"), pages).where("reason is null")
    own = approve_reply(listed.withColumn("type", map_label(F.col("type"))), pages, claims)
    own = own.select("doc_id", "page", "type", "value", "approved", F.lit(1).alias("src"), F.col("pos").alias("rank"), F.lit(0).alias("pat"), F.lit(0).alias("s"))
    rows = first_seen(found.unionByName(own), ORDER).withColumn("source", F.lit(None).cast("string")).select(*COLUMNS)
    return spread_surnames(rows) if surnames else rows


def reviewed(pages: DataFrame, entities: DataFrame, decisions: DataFrame | None = None, custom: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """The entities after a review: decisions (doc_id, value_key, approved), then custom values
    (doc_id, value) that stand in the pages, then the hits (doc_id, page, value) of an instruction."""
    if decisions is not None:
        entities = apply_decisions(entities, decisions)
    if custom is not None:
        entities = add_custom(entities, custom, locate(custom, pages))
    return entities if hits is None else merge_hits(entities, hits)


def rerun(pages: DataFrame, entities: DataFrame, mask: str = "block", images: tuple[DataFrame, DataFrame] | None = None, few_pages: bool = False) -> DataFrame:
    """The original pages redacted anew by what a review left approved, without the pages whose
    selected images fill them. images: the inventory, and the selected (doc_id, id). Documents of
    few pages meet their values as one array, so that no text is repeated for each of them."""
    groups = group_entities(entities).where("approved")
    done = redact_values(pages, groups, mask) if few_pages else redact(pages, groups, mask)
    if images is not None:
        kept = remove_image_pages(pages, *images).where("kept").select("doc_id", "page")
        return done.join(kept, ["doc_id", "page"], "left_semi")
    return done


def redact(pages: DataFrame, entities: DataFrame, mask: str = "block") -> DataFrame:
    """pages with n_redacted and redacted_text: every approved value, wherever it stands."""
    return redact_text(pages, span_union(locate(entities.where("approved"), pages)), mask)


def redact_known(pages: DataFrame, patterns: list[Pattern] | None = None, mask: str = "block") -> DataFrame:
    """Redacts each page's own pattern matches. Works row by row, on streams too."""
    claims = with_claims(pages, DETECTORS if patterns is None else patterns)
    spans = F.array_sort(F.transform(F.filter("claims", lambda c: c["type"].isNotNull()), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))))
    return claims.withColumn("redacted_text", masked(F.coalesce(F.col("text"), F.lit("")), spans, mask)).drop("claims")
