"""The registered queries: each applies an operator to whole given tables, or to rows that Spark
derives from them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.text import chunk_words, clean_for_model, page_list, removal_sentence, value_key
from inkveil.operators import detectors, entities, evaluate, hidden, layout, locate, model, redact, review
from inkveil.plans import derived, pipeline
from inkveil.sources import pages as sources
from inkveil.sources import scratch

#: The types looked for in HTML pages.
TEXT_TYPES = ["Email", "IP Address", "Credit Card", "Phone"]


def _sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Runs derived SQL on the tables of a folder. Customers are dealt to all cores first: what is derived from one is
    far larger than its row, and their table may be a single row group."""
    text, tables = text.replace("{", "{{").replace("}", "}}"), {}
    for name in ("customer", "lineitem"):
        text, n = re.subn(rf"\bFROM {name}\b", f"FROM {{{name}}}", text)
        if n:
            rows = sources.table(spark, folder, name)
            tables[name] = sources.searched_pages(rows, folder, name) if name == "customer" else rows
    return spark.sql(text, **tables)


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged tokens. Line items are dealt by order before they are grouped, so all that follows within a document
    happens in parts of bounded size."""
    items = sources.dealt(sources.table(spark, folder, "lineitem"), f"{folder}/lineitem.parquet", "l_orderkey")
    return spark.sql(derived.TOKENS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=items)


def _matches(pages: DataFrame, kinds: list[str]) -> DataFrame:
    return detectors.matches(pages, kinds)


def detect_email(spark, folder):
    return _matches(sources.document_pages(spark, folder), ["Email"])


def detect_ip(spark, folder):
    return _matches(sources.document_pages(spark, folder), ["IP Address"])


def detect_card(spark, folder):
    return _matches(sources.document_pages(spark, folder), ["Credit Card"])


def detect_phone(spark, folder):
    return _matches(sources.document_pages(spark, folder), ["Phone"])


def _notes(spark, folder):
    return _sql(spark, folder, derived.NOTES)


def detect_ssn(spark, folder):
    return _matches(_notes(spark, folder), ["SSN"])


def detect_iban(spark, folder):
    return _matches(_notes(spark, folder), ["IBAN"])


def detect_birth(spark, folder):
    return _matches(_notes(spark, folder), ["Date of Birth"])


def detect_labelled_ids(spark, folder):
    return _matches(_notes(spark, folder), ["Passport", "Visa", "Case Number", "License Plate", "ID Number"])


def detect_titled(spark, folder):
    return _matches(_notes(spark, folder), ["Person"])


def detect_ipv6(spark, folder):
    return _matches(_notes(spark, folder), ["IP Address"])


def note_entities(spark, folder):
    """All detectors at once, with claims: dates claim their span and yield nothing."""
    return detectors.pattern_entities(_notes(spark, folder))


def _searched(spark, folder):
    return sources.searched_pages(sources.document_pages(spark, folder), folder)


def claimed_entities(spark, folder):
    return detectors.pattern_entities(_searched(spark, folder))


def _source_pages(spark, folder):
    return sources.searched_pages(sources.source_pages(spark, folder), folder)


def _source_entities(spark, folder):
    return pipeline.detect(_source_pages(spark, folder))


def first_seen_entities(spark, folder):
    return _source_entities(spark, folder).select("doc_id", "type", "value", "value_key", "page", "ord")


def surnames(spark, folder):
    people = _sql(spark, folder, derived.PEOPLE).withColumn("type", F.lit("Person"))
    rows = entities.first_seen(people, ["page", "ord"]).withColumn("approved", F.lit(True))
    return entities.spread_surnames(rows.select("doc_id", "type", "value", "value_key", "page", "approved", "ord")).select("doc_id", "value", "page", "ord")


def match_summary(spark, folder):
    found = locate.locate(_source_entities(spark, folder), _source_pages(spark, folder), by_word=True)
    return locate.match_summary(found)


def group_entities(spark, folder):
    return review.group_entities(_source_entities(spark, folder)).drop("source")


def review_list(spark, folder):
    """The texts are searched for entities once; groups and matches are both made of these."""
    rows = _source_entities(spark, folder)
    found = locate.locate(rows, _source_pages(spark, folder), by_word=True)
    return review.review_list(review.group_entities(rows), locate.match_summary(found))


def category_rollup(spark, folder):
    rows = _source_entities(spark, folder).withColumn("approved", F.length("value") % 2 == 0)
    return review.category_rollup(review.group_entities(rows))


def _document_spans(spark, folder):
    pages = sources.document_pages(spark, folder)
    return redact.span_union(locate.locate(pipeline.detect(_searched(spark, folder)), pages))


def redaction_spans(spark, folder):
    return _document_spans(spark, folder)


def redacted_documents(spark, folder):
    """The flagship: detect, locate everywhere, black out."""
    pages = _searched(spark, folder)
    return redact.redact_values(pages, pipeline.detect(pages)).select("doc_id", "page", "n_redacted", "redacted_text")


def stored_redactions(spark, folder):
    """Redacted documents as they are read back: all were written with a dash for each value, by source, and then
    those of all sources but one again with blocks, twice. Values are located once, texts meet them once, and no
    original text goes where redacted ones are stored."""
    docs = sources.table(spark, folder, "documents").select("doc_id", F.lit(1).alias("page"), "text", "source")
    path = scratch.new_path(spark, "redacted")
    found = scratch.written(redact.spans_in(docs, pipeline.detect(sources.searched_pages(docs, folder))), "spans")

    def store(pages, mask):
        sources.write_redacted(redact.redact_spans(pages, mask).select("doc_id", "page", "source", "n_redacted", "redacted_text"), path, ["source"])

    store(found, "-")
    for _ in range(2):
        store(found.where("source <> 'src3'"), "block")
    return spark.read.parquet(path).select("doc_id", "source", "n_redacted", "redacted_text")


def report_history(spark, folder):
    """Reports of two runs, the first of which was repeated, as they are read back."""
    report, path = page_stats(spark, folder).groupBy("has_text").agg(F.count("*").alias("pages"), F.sum("char_count").alias("chars")), scratch.new_path(spark, "reports")
    for run, name in (("r1", "first"), ("r2", "second"), ("r1", "again")):
        sources.write_report(report, path, run, model=name)
    return sources.read_reports(spark, path).select("run", "model", "has_text", "pages", "chars")


def expected_values(spark, folder):
    """People of the notes as expected values: written as a JSON file for each document, and read back."""
    people, path = _sql(spark, folder, derived.PEOPLE), scratch.new_path(spark, "expected")
    sources.write_expected(people.select("doc_id", "value", F.lit("person").alias("type")), path)
    return sources.read_expected(spark, path)


def page_stats(spark, folder):
    return layout.page_stats(sources.document_pages(spark, folder))


def any_text_docs(spark, folder):
    pages = sources.document_pages(spark, folder)
    return pages.join(layout.documents_with_text(layout.page_stats(pages)), "doc_id", "left_semi").select("doc_id")


def image_page_stats(spark, folder):
    """Statistics of pages with images, and the sentence that lists the image-only ones."""
    pages, images = _sql(spark, folder, derived.IMAGE_PAGES), _sql(spark, folder, derived.IMAGES)
    stats = layout.page_stats(pages, images)
    return stats.withColumn("image_coverage", F.round("image_coverage", 9))


def image_only_pages(spark, folder):
    pages, images = _sql(spark, folder, derived.IMAGE_PAGES), _sql(spark, folder, derived.IMAGES)
    rows = layout.image_only_pages(layout.page_stats(pages, images))
    return rows.select("doc_id", "pages", page_list(F.col("pages")).alias("listed"))


def scanned_pages(spark, folder):
    pages, images = _sql(spark, folder, derived.IMAGE_PAGES), _sql(spark, folder, derived.IMAGES)
    return layout.scanned_pages(layout.page_stats(pages, images))


def image_inventory(spark, folder):
    return layout.image_inventory(_sql(spark, folder, derived.IMAGES), _sql(spark, folder, derived.IMAGE_PAGES))


def bounded_image_inventory(spark, folder):
    """Images worth a review where every other page has bounds of its own."""
    return layout.image_inventory(_sql(spark, folder, derived.IMAGES), _sql(spark, folder, derived.IMAGE_PAGES), _sql(spark, folder, derived.BOUNDS))


def image_page_removal(spark, folder):
    pages, found = _sql(spark, folder, derived.IMAGE_PAGES), image_inventory(spark, folder)
    return layout.remove_image_pages(pages, found, found.where("doc_id % 2 = 0"))


def reconstructed_text(spark, folder):
    return layout.page_text(_sql(spark, folder, derived.LINES))


def chunked_documents(spark, folder):
    rows = sources.document_pages(spark, folder).withColumn("chunks", chunk_words(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", "page", F.posexplode("chunks").alias("chunk", "chunk_text"))


def cleaned_documents(spark, folder):
    return sources.document_pages(spark, folder).select("doc_id", "page", clean_for_model(F.coalesce("text", F.lit(""))).alias("cleaned"))


def value_keys(spark, folder):
    return sources.table(spark, folder, "documents").select("doc_id", F.sha2(value_key(F.col("text")), 256).alias("key"))


def conversation_chunks(spark, folder):
    rows = sources.conversation_pages(spark, folder).withColumn("chunks", chunk_words(F.coalesce("text", F.lit("")), 50, 10))
    return rows.select("doc_id", "page", F.posexplode("chunks").alias("chunk", "chunk_text"))


def conversation_stats(spark, folder):
    return layout.page_stats(sources.conversation_pages(spark, folder))


def link_inventory(spark, folder):
    return hidden.link_inventory(sources.html_pages(spark, folder))


def removal_reports(spark, folder):
    rows = sources.html_pages(spark, folder).select("doc_id", hidden.removal_report(F.col("html")).alias("kinds"))
    return rows.withColumn("sentence", removal_sentence(F.col("kinds")))


def stripped_pages(spark, folder):
    return sources.html_pages(spark, folder).select("doc_id", hidden.strip_hidden(F.col("html")).alias("html"))


def stripped_forms(spark, folder):
    """Pages with forms, attachments and alternative texts of all spellings, without them."""
    rows = _sql(spark, folder, derived.FORMS)
    return rows.select("doc_id", hidden.strip_hidden(F.col("html")).alias("html"), hidden.removal_report(F.col("html")).alias("kinds"))


def html_pii(spark, folder):
    return _matches(sources.html_pages(spark, folder).withColumnRenamed("html", "text"), TEXT_TYPES)


def grouped_tokens(spark, folder):
    rows = model.group_tokens(_tokens(spark, folder))
    return rows.withColumn("score", F.round("score", 9))


def _tagged_people(spark, folder):
    return _sql(spark, folder, derived.PEOPLE).select("doc_id", "page", F.lit(0).alias("chunk"), F.lit(1).alias("grp"), F.lit("PERSON").alias("tag"), F.regexp_replace("value", ", Jr.$| MD$", "").alias("word"), ((40 + F.col("ord") % 6 * 10) / 100).alias("score"))


def tagged_entities(spark, folder):
    """A tagger's entities (the people of the notes) through all filters and pattern claims."""
    pages = _notes(spark, folder)
    found = model.filter_entities(_tagged_people(spark, folder), pages, detectors.claims_table(pages))
    return found.select("doc_id", "page", "type", "value")


def tagger_only(spark, folder):
    """The notes' entities with the patterns and the surnames switched off."""
    rows = pipeline.detect(_notes(spark, folder), _tagged_people(spark, folder), patterns=[], surnames=False)
    return rows.select("doc_id", "type", "value", "value_key", "page", "ord")


def reply_entities(spark, folder):
    rows = _sql(spark, folder, derived.REPLIES).withColumn("content", F.concat("head", "tail"))
    return model.reply_entities(rows)


def _reply_lines(spark, folder, silent=False):
    rows = _sql(spark, folder, derived.REPLIES)
    if silent:
        rows = rows.withColumn("head", F.when(F.col("k") % 6 == 0, "").otherwise(F.col("head")))
    line = lambda text, done, error: F.to_json(F.struct(F.struct(text.alias("content")).alias("message"), done.alias("done"), F.when(done, "stop").alias("done_reason"), error.alias("error")))
    none = F.lit(None).cast("string")
    lines = F.array(F.struct(F.lit(0).alias("seq"), line(F.col("head"), F.lit(False), none).alias("line")), F.struct(F.lit(1).alias("seq"), line(F.lit(""), F.lit(False), F.when(F.col("k") % 3 == 0, "lost")).alias("line")), F.struct(F.lit(2).alias("seq"), line(F.col("tail"), F.lit(True), none).alias("line")))
    return rows.select("doc_id", "page", F.inline(lines))


def assembled_replies(spark, folder):
    """Replies cut into streamed lines, some with an error, put together again."""
    return model.assemble_replies(_reply_lines(spark, folder))


def run_flags(spark, folder):
    """Flags of the same replies, of which every sixth fails before a word."""
    return evaluate.run_flags(model.assemble_replies(_reply_lines(spark, folder, silent=True)))


def repeat_loops(spark, folder):
    return model.repeat_loops(_sql(spark, folder, derived.LISTED))


def deduped_reply(spark, folder):
    return model.dedupe_reply(_sql(spark, folder, derived.LISTED))


def reply_reasons(spark, folder):
    notes = _notes(spark, folder).withColumn("page", F.floor((F.col("page") - 1) / 500).cast("int") + 1)
    notes = notes.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    rows = model.with_reasons(_sql(spark, folder, derived.LISTED), notes)
    return rows.select("doc_id", "page", "pos", "type", "value", "reason")


def model_thresholds(spark, folder):
    """Types and, for two known taggers and any other, least scores of all tags of the tokens."""
    rows = _tokens(spark, folder).select(F.regexp_replace("tag", "^[A-Z]-", "").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    rows = rows.withColumn("type", model.map_label(F.col("tag")))
    limits = [F.struct(F.lit(name).alias("model"), model.min_score(F.col("type"), model.min_scores_of(name)).alias("min_score")) for name in ("accurate", "small", "other")]
    return rows.select("tag", "n", "type", F.inline(F.array(*limits)))


def decided_entities(spark, folder):
    rows = _source_entities(spark, folder)
    decisions = rows.where(F.length("value") % 3 == 0).select("doc_id", "value_key", F.lit(False).alias("approved"))
    return review.apply_decisions(rows, decisions).select("doc_id", "value_key", "approved")


def _custom(spark, folder):
    """Of every source a value that stands in its texts, and one that doesn't."""
    rows = sources.table(spark, folder, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.min_by(F.regexp_extract("text", "[A-Za-z]{3,}", 0), "doc_id").alias("value"))
    return rows.where("value <> ''").unionByName(rows.select("doc_id", F.lit("no such value").alias("value")))


def custom_entities(spark, folder):
    rows, custom = _source_entities(spark, folder), _custom(spark, folder)
    found = locate.locate(custom, _source_pages(spark, folder), by_word=True)
    return review.add_custom(rows, custom, found).where("type = 'Custom'").select("doc_id", "type", "value", "page", "approved")


def classified_hits(spark, folder):
    rows = _source_entities(spark, folder).withColumn("approved", F.length("value") % 2 == 0)
    hits = rows.where("ord % 2 = 1").select("doc_id", F.upper("value").alias("value")).unionByName(_custom(spark, folder))
    return review.classify_hits(rows, hits)


def unapplied_changes(spark, folder):
    rows = _source_entities(spark, folder)
    after = rows.withColumn("approved", F.col("approved") & (F.col("doc_id") != "src3"))
    ids = sources.table(spark, folder, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("id"))
    return review.unapplied_changes(rows, after, ids, ids.where("doc_id <> 'src5' or id <> 'en'"))


def kept_links(spark, folder):
    """External links to remove; the given pages' own urls serve as absolute links."""
    rows = sources.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit('<a href="'), "url", F.lit('">x</a><a href="#top">y</a>')).alias("html"), "url")
    keep = rows.where("doc_id % 2 = 0").select("doc_id", "url")
    return hidden.unlink_all_but(rows, keep)


def reviewable_documents(spark, folder):
    pages = sources.html_pages(spark, folder)
    return hidden.reviewable(pages, image_inventory(spark, folder), hidden.link_inventory(pages))


def _expected(spark, folder):
    """What should have been found: all e-mail addresses, and every document's first word."""
    named = lambda kind: lambda v: F.struct(v.alias("value"), F.lit(kind).alias("type"))
    none = F.array().cast("array<string>")
    mails = F.when(F.contains("text", F.lit("@")), F.regexp_extract_all("text", F.lit(r"[\w.+-]++@[\w-]+(?:\.[\w-]+)+"), F.lit(0))).otherwise(none)
    word = F.filter(F.array(F.regexp_extract("text", "[A-Za-z]{2,}", 0)), lambda w: w != "")
    # Of an inner inline the optimizer makes a filter, which would search all texts once more.
    rows = sources.table(spark, folder, "documents").select("doc_id", F.inline_outer(F.concat(F.transform(mails, named("Email")), F.transform(word, named("Word")))))
    return rows.where("value is not null")


def evaluated_documents(spark, folder):
    pages = _searched(spark, folder)
    found = pipeline.detect(pages).where("approved")
    return evaluate.evaluate_documents(_expected(spark, folder), found, redact.redact_values(pages, found))


def evaluated_corpus(spark, folder):
    return evaluate.evaluate_corpus(evaluated_documents(spark, folder))


def evaluated_rollup(spark, folder):
    """Totals by source and type of value, by each of them, and over all."""
    pages = _searched(spark, folder)
    found = pipeline.detect(pages).where("approved")
    return evaluate.evaluate_rollup(_expected(spark, folder), found, redact.redact_values(pages, found), sources.table(spark, folder, "documents"))


def bounded_page_stats(spark, folder):
    """Image coverage where every other page has bounds of its own."""
    pages, images = _sql(spark, folder, derived.IMAGE_PAGES), _sql(spark, folder, derived.IMAGES)
    return layout.page_stats(pages, images, _sql(spark, folder, derived.BOUNDS)).withColumn("image_coverage", F.round("image_coverage", 9))


def unlinked_pages(spark, folder):
    """Pages without external links; each page's own url is one, and pages of even number keep theirs."""
    anchor = F.concat(F.lit('<a class="own" href="'), "url", F.lit('">this page</a>'))
    pages = sources.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.concat(anchor, "html", anchor).alias("html"))
    keep = hidden.link_inventory(pages).where("doc_id % 2 = 0").select("doc_id", "url")
    return hidden.unlinked(pages, keep).select("doc_id", "html")


def instruction_hits(spark, folder):
    return model.instruction_hits(_sql(spark, folder, derived.FOUND), _notes(spark, folder))


def _note_groups(spark, folder):
    return pipeline.detect(_notes(spark, folder), surnames=False).withColumn("approved", F.length("value") % 2 == 0)


def merged_hits(spark, folder):
    """The notes' entities after an instruction's hits were merged into them."""
    rows = review.merge_hits(_note_groups(spark, folder), instruction_hits(spark, folder))
    return rows.select("doc_id", "value_key", "type", "source", "approved")


def changed_by_hits(spark, folder):
    return review.changed_by_hits(_note_groups(spark, folder), instruction_hits(spark, folder))


def rerun_notes(spark, folder):
    """The cards redacted anew after a review: what patterns found but for telephone numbers, which were decided
    against, the word `plate`, which was added, and a name that an instruction found; without the pages whose images were
    selected, those of every fifth card that isn't the document's only page."""
    cards = _sql(spark, folder, derived.CARDS)
    images = cards.where("doc_id % 5 = 0").select("doc_id", F.lit(2).alias("page"), F.lit(0).alias("idx"), F.lit("2:0").alias("id"), F.lit(True).alias("full_page"))
    pages = cards.unionByName(cards.where("doc_id % 5 < 2").select("doc_id", F.lit(2).alias("page"), F.lit("scan of a plate").alias("text")))
    found = pipeline.detect(cards, surnames=False).withColumn("approved", F.col("type") != "Person")
    decisions = found.where("type = 'Phone'").select("doc_id", "value_key", F.lit(False).alias("approved"))
    custom = cards.select("doc_id", F.lit("plate").alias("value"))
    hits = _sql(spark, folder, derived.NAMES).where("k % 2 = 0").select(F.col("k").cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("person").alias("value"))
    rows = pipeline.reviewed(pages, found, decisions, custom, hits)
    return pipeline.rerun(pages, rows, images=(images, images), few_pages=True).select("doc_id", "page", "n_redacted", "redacted_text")


def claimed_values(spark, folder):
    """Whether all places of a number in a note are claimed by its patterns."""
    value = F.expr("CASE page % 3 WHEN 0 THEN '2020' WHEN 1 THEN cast(89999 + page as string) ELSE '12' END")
    rows = scratch.written(detectors.with_claims(_notes(spark, folder)), "claims").withColumn("value", value)
    return rows.select("doc_id", "page", "value", detectors.is_claimed(F.col("value"), F.col("text"), F.col("claims")).alias("claimed"))


def snapped_words(spark, folder):
    """A tagger's words, with blanks, capitals or ends that the notes don't have, as the notes have them."""
    rows = _sql(spark, folder, derived.NAMES).join(_notes(spark, folder), ["doc_id", "page"])
    word = F.expr("CASE k % 4 WHEN 0 THEN replace(person, ' ', '  ') WHEN 1 THEN upper(person) WHEN 2 THEN substring(person, 2, length(person) - 2) ELSE ' Nobody Here ' END")
    return rows.select("doc_id", "page", model.snap_to_words(word, F.col("text")).alias("word"))


def cleaned_people(spark, folder):
    value = F.expr("CASE k % 3 WHEN 0 THEN concat(person, ' of the') WHEN 1 THEN concat('Bo\n', person) ELSE 'Ann\nLee' END")
    return _sql(spark, folder, derived.NAMES).select("doc_id", "page", model.clean_person(value).alias("value"))


def chat_entities(spark, folder):
    """Patterns and a chat model's streamed replies as one dataflow."""
    return pipeline.detect_chat(_sql(spark, folder, derived.CARDS), _reply_lines(spark, folder)).select("doc_id", "type", "value", "page", "approved", "ord")


def _capitals():
    return lambda texts: [[{"idx": k, "tag": "B-WORD", "score": 1.0, "piece": w} for k, w in enumerate(t.split(" ")) if "A" <= w[:1] <= "Z"] for t in texts]


def scored_chunks(spark, folder):
    """A caller's model on all chunks of the conversations: it tags words with a capital."""
    chunks = conversation_chunks(spark, folder).withColumnRenamed("chunk_text", "text")
    return model.tokens_of(model.score_chunks(chunks, _capitals)).select("doc_id", "page", "chunk", "idx", "tag", "piece")


def _strict():
    """Tags words with a capital, and gives up on chunks that hold an x."""
    tag = _capitals()

    def model(texts):
        if any("x" in t for t in texts):
            raise ValueError("no model for x")
        return tag(texts)

    return model


def _strictly_scored(spark, folder):
    chunks = conversation_chunks(spark, folder).withColumnRenamed("chunk_text", "text")
    return chunks, scratch.written(model.score_chunks(chunks, _strict), "scored")


def model_flags(spark, folder):
    """How a model that fails on some chunks ran on each conversation."""
    return model.model_flags(_strictly_scored(spark, folder)[1])


def fallback_conversations(spark, folder):
    """What that model tags, and for the conversations that it failed on each chunk's first word instead."""
    chunks, scored = _strictly_scored(spark, folder)
    first = model.tokens_of(scored).select("doc_id", "page", "chunk", F.col("piece").alias("value"))
    second = chunks.select("doc_id", "page", "chunk", F.regexp_extract("text", "^[^ ]+", 0).alias("value"))
    return model.scored_or(scored, first, second)


def fallback_entities(spark, folder):
    """A chat model's entities where no page failed, else what the patterns find."""
    replies = assembled_replies(spark, folder)
    first = model.reply_entities(replies).select("doc_id", "type", "value")
    second = detectors.pattern_entities(_sql(spark, folder, derived.CARDS)).select("doc_id", "type", "value")
    return model.fallback(first, second, evaluate.run_flags(replies).where("not failed"))


_ALL = [
    detect_email, detect_ip, detect_card, detect_phone, detect_ssn, detect_iban, detect_birth, detect_labelled_ids, detect_titled, detect_ipv6, note_entities,
    claimed_entities, first_seen_entities, surnames, match_summary, group_entities, review_list, category_rollup, redaction_spans, redacted_documents, stored_redactions, report_history, expected_values,
    page_stats, any_text_docs, image_page_stats, image_only_pages, scanned_pages, image_inventory, image_page_removal, reconstructed_text, chunked_documents,
    cleaned_documents, value_keys, conversation_chunks, conversation_stats, link_inventory, removal_reports, stripped_pages, stripped_forms, html_pii, grouped_tokens,
    tagged_entities, tagger_only, bounded_image_inventory, reply_entities, assembled_replies, run_flags, repeat_loops, deduped_reply, reply_reasons, model_thresholds, decided_entities,
    custom_entities, classified_hits, unapplied_changes, kept_links, reviewable_documents, evaluated_documents, evaluated_corpus, evaluated_rollup, model_flags, fallback_conversations,
    bounded_page_stats, unlinked_pages, instruction_hits, merged_hits, changed_by_hits, rerun_notes, claimed_values, snapped_words, cleaned_people, chat_entities,
    scored_chunks, fallback_entities,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
