"""Links and hidden content of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import let, running, stitched

#: A link's address stands between double or single quotes.
HREF = r"""(?i)<a\s[^>]*?href=("[^"]*"|'[^']*')"""
ANCHOR = r"""(?is)<a\s[^>]*?href=("[^"]*"|'[^']*')[^>]*>(.*?)</a>"""
#: What a reader doesn't see but a parser does, in the order in which it is reported.
KINDS = ["metadata", "scripts", "comments", "attachments", "alternative text", "form data"]
#: A comment, a script with what it holds, or a tag. Quoted values may hold angle brackets; a tag whose
#: quotes don't close ends at the first one.
TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<script(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</script\s*+>|\z)|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*+>"""
ATTRIBUTE = r"""\s++[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
#: Elements by kind: those that go with all they hold, and those that are a single tag.
HOLDING = {"attachments": ["object", "applet"], "form data": ["textarea", "select", "button"]}
SINGLE = {"metadata": ["meta"], "attachments": ["embed"], "form data": ["input"]}
SPOKEN = ["alt", "title"]


def is_external(url: Column) -> Column:
    """A link with a scheme leaves the document."""
    return F.regexp_like(url, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:"))


def _bare(quoted: Column) -> Column:
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def link_inventory(pages: DataFrame) -> DataFrame:
    """(doc_id, url, is_external, pages, count, first_page, first_pos) of every link in `html`."""
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)), _bare)
    rows = pages.select("doc_id", "page", F.posexplode(links).alias("pos", "url"))
    first = F.min(F.struct("page", "pos"))
    own = rows.groupBy("doc_id", "url").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.count("*").alias("count"), first.alias("f"))
    return own.select("doc_id", "url", is_external(F.col("url")).alias("is_external"), "pages", "count", F.col("f.page").alias("first_page"), F.col("f.pos").alias("first_pos"))


def _name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _is_spoken(attribute: Column) -> Column:
    return F.lower(F.regexp_extract(attribute, r"^\s+([^\s=]+)\s*=", 1)).isin(SPOKEN)


def _kind(token: Column) -> Column:
    """The kind of hidden content that a token is, or null."""
    out = F.when(token.startswith("<!--"), F.lit("comments")).when(_name(token) == "script", F.lit("scripts"))
    for names in (SINGLE, HOLDING):
        for kind, own in names.items():
            out = out.when(_name(token).isin(own), F.lit(kind))
    return out


def _depths(tokens: Column) -> Column:
    """How many elements that go with all they hold are open after each token."""
    holding = [n for own in HOLDING.values() for n in own]
    step = F.transform(tokens, lambda t: F.when(~_name(t).isin(holding) | t.endswith("/>"), 0).when(t.startswith("</"), -1).otherwise(1))
    return running(step, lambda a, b: F.greatest(a + b, F.lit(0)))


def strip_hidden(html: Column) -> Column:
    """The page without what a reader doesn't see: one pass over its tags, which knows what element it is in.

    Comments, scripts, metadata, attachments and form controls go with what they hold; of other tags the
    alternative texts go. An element that isn't closed ends with the page.
    """

    def build(x: Column, depths: Column) -> Column:
        def kept(t: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.element_at(depths, F.greatest(i, F.lit(1))))
            tag = F.when((before > 0) | _kind(t).isNotNull(), F.lit("")).otherwise(stitched(t, ATTRIBUTE, lambda a: F.when(_is_spoken(a), F.lit("")).otherwise(a)))
            return F.concat(tag, F.when(F.element_at(depths, i + 1) > 0, F.lit("")).otherwise(F.element_at(x["gaps"], i + 2)))

        return F.concat(F.element_at(x["gaps"], 1), F.array_join(F.transform(x["tokens"], kept), ""))

    parts = F.struct(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)).alias("tokens"), F.split(html, TOKEN, -1).alias("gaps"))
    return let(parts, lambda x: F.when(F.size(x["tokens"]) == 0, html).otherwise(let(_depths(x["tokens"]), lambda d: build(x, d))))


def removal_report(html: Column) -> Column:
    """The kinds of hidden content that there are, in fixed order."""

    def kinds(tokens: Column) -> Column:
        found = F.array_distinct(F.filter(F.transform(tokens, _kind), lambda k: k.isNotNull()))
        tags = F.filter(tokens, lambda t: ~t.startswith("<!--") & (_name(t) != "script"))
        spoken = F.exists(tags, lambda t: F.exists(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)), _is_spoken))
        found = F.when(spoken, F.array_append(found, F.lit("alternative text"))).otherwise(found)
        return let(found, lambda own: F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.array_contains(own, k)))

    return let(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)), kinds)


def unlink(html: Column, keep: Column | None = None) -> Column:
    """External links become their text; links within the document stay, and so do those whose
    address is in `keep`, an array (null or absent: none)."""

    def change(anchor: Column) -> Column:
        url = _bare(F.regexp_extract(anchor, ANCHOR, 1))
        goes = is_external(url) if keep is None else is_external(url) & ~F.array_contains(F.coalesce(keep, F.array().cast("array<string>")), url)
        return F.when(goes, F.regexp_extract(anchor, ANCHOR, 2)).otherwise(anchor)

    return stitched(html, ANCHOR, change)


def unlinked(pages: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """pages (doc_id, html) without external links, but for those in `keep` (doc_id, url)."""
    if keep is None:
        return pages.withColumn("html", unlink(F.col("html")))
    own = keep.groupBy("doc_id").agg(F.collect_set("url").alias("_keep"))
    return pages.join(own, "doc_id", "left").withColumn("html", unlink(F.col("html"), F.col("_keep"))).select(*pages.columns)


def unlink_all_but(pages: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(doc_id, url) of the external links to remove: those not in `keep` (doc_id, url)."""
    external = link_inventory(pages).where("is_external").select("doc_id", "url")
    return external if keep is None else external.join(keep.select("doc_id", "url"), ["doc_id", "url"], "left_anti")


def reviewable(docs: DataFrame, images: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, reviewable): whether a document has an image to review or an external link."""
    found = images.select("doc_id").unionByName(links.where("is_external").select("doc_id")).distinct().withColumn("reviewable", F.lit(True))
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").withColumn("reviewable", F.coalesce("reviewable", F.lit(False)))
