"""What taggers and chat models return: grouped tokens, filtered entities, salvaged replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import fixed
from inkveil.functions.text import appears, let, occurrences, once, quoted, trimmed, words_of
from inkveil.operators.detectors import has_birth_context, is_claimed

_W = r"[\p{L}\p{N}]"


def group_tokens(tokens: DataFrame) -> DataFrame:
    """Merges tagged tokens (doc_id, page, chunk, idx, tag, score, piece) into entities.

    A token joins the group before it if that is open, has the same tag, ends at the index before,
    and the token doesn't begin one (B) or stand alone (S). S closes its group at once; E closes a
    group that it joins, and leaves one open that it begins. Pieces that start with ## join
    without a blank; the score is the mean.
    """
    prefixed = F.substring("tag", 2, 1) == "-"
    rows = tokens.withColumn("prefix", F.when(prefixed, F.substring("tag", 1, 1)).otherwise("I")).withColumn("name", F.when(prefixed, F.substring("tag", 3, 1 << 20)).otherwise(F.col("tag")))
    keys = ["doc_id", "page", "chunk"]
    chunk = Window.partitionBy(*keys).orderBy("idx")
    so_far = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c: F.lag(c).over(chunk)
    rows = rows.withColumns({"p_name": before("name"), "p_idx": before("idx"), "p_prefix": before("prefix")})
    fits = (F.col("p_name") == F.col("name")) & ~F.col("prefix").isin("B", "S") & (F.col("idx") == F.col("p_idx") + 1)
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)))
    # Of E tokens in a row, one that joins closes the group, so the next begins one, and so on.
    rows = rows.withColumn("run", F.sum((~(F.col("fits") & (F.col("prefix") == "E") & (F.col("p_prefix") == "E"))).cast("int")).over(so_far))
    run = Window.partitionBy(*keys, "run").orderBy("idx")
    first = F.first(F.col("fits") & (F.col("p_prefix") != "S")).over(run)
    odd = (F.row_number().over(run) - 1) % 2 == 1
    rows = rows.withColumn("end_joins", (F.col("prefix") == "E") & (first != odd))
    rows = rows.withColumn("p_open", F.lag((F.col("prefix") != "S") & ~F.col("end_joins")).over(chunk))
    joins = F.when(F.col("prefix") == "E", F.col("end_joins")).otherwise(F.col("fits") & F.col("p_open"))
    rows = rows.withColumn("grp", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(so_far))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"])
    own = rows.groupBy("doc_id", "page", "chunk", "grp").agg(F.first("name").alias("tag"), F.avg("score").alias("score"), pieces.alias("pieces"))
    word = F.regexp_replace(F.array_join("pieces", " "), " ##", "")
    return own.select("doc_id", "page", "chunk", F.col("grp").cast("int").alias("grp"), "tag", word.alias("word"), "score")


def map_label(tag: Column) -> Column:
    known = F.create_map(*[x for k, v in fixed.TAG_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, tag), tag)


def min_scores_of(name: str | None) -> dict[str, float]:
    """The least scores that a known tagger sets instead of the common ones; none for others."""
    return fixed.MODEL_MIN_SCORES.get(name, {})


def min_score(kind: Column, overrides: dict[str, float] | None = None) -> Column:
    limits = fixed.MIN_SCORES | {"default": fixed.DEFAULT_MIN_SCORE} | (overrides or {})
    default = limits.pop("default")
    own = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(own, kind), F.lit(float(default)))


def snap_to_words(word: Column, text: Column) -> Column:
    """The word as the page has it: as whole words, then in any case, then grown to word edges."""
    body = F.array_join(quoted(words_of(word)), r"\s*")
    whole = F.concat(F.lit(rf"(?<!{_W})"), body, F.lit(rf"(?!{_W})"))
    tries = [F.regexp_substr(text, whole), F.regexp_substr(text, F.concat(F.lit("(?iu)"), whole)), F.regexp_substr(text, F.concat(F.lit(f"(?iu){_W}*?"), body, F.lit(f"{_W}*")))]
    return F.when(F.size(words_of(word)) == 0, F.lit("")).otherwise(F.coalesce(*tries, trimmed(word)))


def clean_person(value: Column) -> Column:
    """Of several lines the longest by words, if it has more than one; no small words at the end."""
    none = F.lit("")
    better = lambda best, x: F.when((best == "") | (F.size(words_of(x)) > F.size(words_of(best))), x).otherwise(best)
    # The index of a word after which only small words follow.
    end = lambda words: F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda k: (k == 1) | ~F.regexp_like(F.coalesce(F.try_element_at(words, k), none), F.lit(r"^\p{Ll}"))))
    chosen = lambda lines: let(words_of(F.aggregate(lines, none, better)), lambda longest: F.when(F.size(longest) > 1, longest).otherwise(words_of(F.array_join(lines, " "))))
    lines = F.filter(F.transform(F.split(value, "\n", -1), trimmed), lambda x: x != "")
    return let(let(lines, chosen), lambda words: F.array_join(F.slice(words, F.lit(1), end(words)), " "))


def _texts(pages: DataFrame) -> DataFrame:
    """The texts of pages, to be merged: texts that are put together are far larger than the optimizer takes them for,
    and must not be broadcast."""
    return pages.select("doc_id", "page", "text").hint("merge")


def _with_claims(rows: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """rows of pages with the page's text and claims; a page that isn't in `claims` has none."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    own = claims.select("doc_id", "page", F.transform("claims", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))).alias("claims"))
    rows = rows.join(own.hint("merge"), ["doc_id", "page"], "left").join(_texts(pages), ["doc_id", "page"])
    return rows.withColumn("claims", F.coalesce("claims", none))


def filter_entities(found: DataFrame, pages: DataFrame, claims: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, page, type, value, score, chunk, grp) of the tagger's entities that stand.

    pages: doc_id, page, text; claims: doc_id, page, claims. The filters are applied in a fixed order, each on what the
    one before made of the value.
    """
    rows = found.where(F.col("tag").isNotNull() & (F.col("tag") != "") & ~F.col("tag").isin(fixed.DROPPED_TAGS))
    rows = rows.withColumn("type", map_label(F.col("tag"))).where(F.col("score") >= min_score(F.col("type"), overrides))
    rows = _with_claims(rows, pages, claims)
    text, value = F.col("text"), F.col("value")
    named = let(snap_to_words(F.regexp_replace("word", "^##", ""), text), lambda v: F.when(F.col("type") == "Person", clean_person(v)).otherwise(v))
    rows = once(rows, "value", named)
    rows = rows.where(F.length("value") >= 3)
    rows = rows.where(~(F.col("type").isin(fixed.NAMED_TYPES) & F.regexp_like(value, F.lit(r"^\p{Ll}"))) & ~F.regexp_like(value, F.lit("^[A-Z]{2,4}$")))
    rows = rows.where((F.col("type") != "Date") | is_birth_date(value, text))
    rows = rows.where(~is_claimed(value, text, F.col("claims")) & ~F.lower("value").isin(fixed.FIELD_WORDS))
    return rows.select("doc_id", "page", "type", "value", "score", "chunk", "grp")


def is_birth_date(value: Column, text: Column) -> Column:
    """Whether one of the value's occurrences has a birth word before it."""
    return F.exists(occurrences(value, text), lambda x: has_birth_context(text, x["s"]))


REPLY_LINE = "message struct<content:string>, done boolean, done_reason string, error string"


def assemble_replies(replies: DataFrame) -> DataFrame:
    """(doc_id, page, content, stop_reason, error) of streamed reply lines (doc_id, page, seq, line).

    Lines after `done` or an error are left out; what came before an error is kept.
    """
    rows = replies.withColumn("x", F.from_json("line", REPLY_LINE))
    stop = F.min(F.when(F.col("x.done") | F.col("x.error").isNotNull(), F.col("seq"))).over(Window.partitionBy("doc_id", "page"))
    rows = rows.withColumn("stop", stop).where("stop is null or seq <= stop")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("x.message.content", F.lit("")).alias("c")))), lambda p: p["c"])
    return rows.groupBy("doc_id", "page").agg(F.array_join(parts, "").alias("content"), F.max("x.done_reason").alias("stop_reason"), F.max("x.error").alias("error"))


def reply_entities(content: DataFrame) -> DataFrame:
    """(doc_id, page, pos, type, value) of the flat objects in `content` with a string type and a
    string value of two characters or more."""
    rows = content.select("doc_id", "page", F.posexplode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("pos", "raw"))
    rows = once(rows, "v", F.try_parse_json("raw"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    rows = rows.where((kind("type") == "STRING") & (kind("value") == "STRING"))
    rows = rows.select("doc_id", "page", "pos", text("type").alias("type"), trimmed(text("value")).alias("value"))
    return rows.where(F.length("value") >= 2)


def entity_key() -> Column:
    return F.concat_ws(":", F.col("type"), F.lower("value"))


def repeat_loops(entities: DataFrame) -> DataFrame:
    """(doc_id, page, key, pos): the first entity that came 3 times running or 6 times in all."""
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    rows = entities.withColumn("key", entity_key())
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("doc_id", "page", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("block", F.row_number().over(page) - F.col("total"))
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy("doc_id", "page", "key", "block").orderBy("pos")))
    hits = rows.where((F.col("streak") >= fixed.MAX_CONSECUTIVE) | (F.col("total") >= fixed.MAX_TOTAL))
    return hits.groupBy("doc_id", "page").agg(F.min_by("key", "pos").alias("key"), F.min("pos").alias("pos"))


def dedupe_reply(entities: DataFrame) -> DataFrame:
    """The first entity of each type and value, before any repeat loop sets in."""
    loops = repeat_loops(entities).select("doc_id", "page", F.col("pos").alias("loop_pos"))
    rows = entities.join(loops, ["doc_id", "page"], "left").where("loop_pos is null or pos <= loop_pos").withColumn("key", entity_key())
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "key").orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "key", "loop_pos")


def with_reasons(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """entities plus `reason`: why a chat model's entity is rejected, null if it stands."""
    orgs = entities.where("type = 'Organization'").groupBy("doc_id", "page").agg(F.collect_set(F.lower("value")).alias("orgs"))
    rows = entities.join(orgs, ["doc_id", "page"], "left").join(_texts(pages), ["doc_id", "page"])
    rows = rows.withColumn("orgs", F.coalesce("orgs", F.array().cast("array<string>")))
    too_long, absent, no_letters, small, long_person, short_person, digits, part = fixed.REASONS
    value, words = F.col("value"), F.size(words_of(F.col("value")))
    person = F.col("type") == "Person"
    reason = (
        F.when((words > fixed.MAX_REPLY_WORDS) | (F.length("value") > fixed.MAX_REPLY_CHARS), too_long)
        .when(~appears(value, F.col("text")), absent)
        .when(F.col("type") == "Miscellaneous", F.lit(None))
        .when(~F.regexp_like(value, F.lit(r"\p{L}")), no_letters)
        .when(value == F.lower(value), small)
        .when(person & (words > 4), long_person)
        .when(person & (words == 1) & (F.length("value") < 3), short_person)
        .when(person & F.regexp_like(value, F.lit(r"\d")), digits)
        .when(person & F.exists("orgs", lambda o: F.contains(o, F.lower("value"))), part)
    )
    return rows.withColumn("reason", reason).drop("orgs", "text")


def approve_reply(entities: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities no pattern has claimed; all but Miscellaneous are approved."""
    rows = _with_claims(entities, pages, claims)
    rows = rows.where(~is_claimed(F.col("value"), F.col("text"), F.col("claims")))
    return rows.drop("text", "claims").withColumn("approved", F.col("type") != "Miscellaneous")


def instruction_hits(replies: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, value) of the strings of a reply that is a list, 2 to 120 characters and 15
    words at most, that stand in the page; blank and over-long pages are passed over."""
    rows = replies.select("doc_id", "page", F.posexplode(F.from_json("content", "array<variant>")).alias("pos", "v"))
    rows = rows.where(F.schema_of_variant("v") == "STRING").select("doc_id", "page", "pos", trimmed(F.col("v").cast("string")).alias("value"))
    own = _texts(pages.where((F.trim("text") != "") & (F.length("text") <= fixed.MAX_PAGE_CHARS)))
    rows = rows.where(F.length("value").between(2, fixed.MAX_INSTRUCTION_CHARS) & (F.size(words_of(F.col("value"))) <= fixed.MAX_INSTRUCTION_WORDS))
    return rows.join(own, ["doc_id", "page"]).where(appears(F.col("value"), F.col("text"))).drop("text")


#: Bytes of texts that a model gets at once.
BATCH_BYTES = 1 << 20
TOKENS = "array<struct<idx:int,tag:string,score:double,piece:string>>"


def _called(model: Callable, texts: list[str]) -> list[tuple[str, str | None, list[dict]]]:
    """(status, error, tokens) of each text. Where the model fails on all at once, each is tried by itself."""
    try:
        found = [list(x) for x in model(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [("ok", None, x) for x in found]
    except Exception as e:  # whatever a caller's model raises is that chunk's error
        if len(texts) == 1:
            return [("failed", f"{type(e).__name__}: {e}", [])]
        return [r for t in texts for r in _called(model, [t])]


def score_chunks(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], most_chars: int = fixed.MAX_PAGE_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, page, chunk, status, error, tokens) of each chunk (doc_id, page, chunk, text), one row for each.

    `load()` gives, once for each task, a function from texts to lists of {idx, tag, score, piece}. It gets
    texts of about `batch_bytes` at most at once. A chunk that it raises an error for is `failed`, with the error,
    a longer one than `most_chars` is `skipped`, all others are `ok`; if it can't be loaded all of a task fail.
    """
    columns = ["doc_id", "page", "chunk", "status", "error", "tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = load()
        except Exception as e:
            error = e

            def model(texts: list[str]) -> list[list[dict]]:
                raise error

        for batch in batches:
            keys, rows, held, size = list(batch[["doc_id", "page", "chunk"]].itertuples(index=False)), [], [], 0

            def flush() -> None:
                rows.extend((*keys[at], *r) for (at, _), r in zip(held, _called(model, [t for _, t in held])))
                held.clear()

            for at, text in enumerate(batch["text"].tolist()):
                if text is None or len(text) > most_chars:
                    rows.append((*keys[at], "skipped", None, []))
                    continue
                own = len(text.encode())
                if held and size + own > batch_bytes:
                    flush()
                    size = 0
                held.append((at, text))
                size += own
            if held:
                flush()
            yield pd.DataFrame(rows, columns=columns)

    kinds = dict(chunks.dtypes)
    own = chunks.select("doc_id", "page", "chunk", "text")
    return own.mapInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, chunk {kinds['chunk']}, status string, error string, tokens {TOKENS}")


def tokens_of(scored: DataFrame) -> DataFrame:
    """(doc_id, page, chunk, idx, tag, score, piece) of all chunks that a model has scored."""
    return scored.select("doc_id", "page", "chunk", F.inline("tokens"))


def model_flags(scored: DataFrame) -> DataFrame:
    """(doc_id, chunks, failed, skipped, model_used, fell_back, error): how the model ran on each document. One that
    failed on any chunk falls back; error is that of its first failed chunk."""
    failed = F.col("status") == "failed"
    own = scored.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(failed).alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.bool_or(F.col("status") == "ok").alias("any"), F.min_by(F.when(failed, F.col("error")), F.when(failed, F.struct("page", "chunk"))).alias("error"))
    return own.select("doc_id", "chunks", "failed", "skipped", (F.col("any") & (F.col("failed") == 0)).alias("model_used"), (F.col("failed") > 0).alias("fell_back"), "error")


def scored_or(scored: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Results of `primary`, made from what a model scored, for documents that it didn't fail on; of `secondary` for
    all others, also those that it never got."""
    return fallback(primary, secondary, model_flags(scored).where("not fell_back"))


def fallback(primary: DataFrame, secondary: DataFrame, ok: DataFrame) -> DataFrame:
    """Results of `primary` for documents in `ok` (doc_id), of `secondary` for all others."""
    good = ok.select("doc_id").distinct()
    return primary.join(good, "doc_id", "left_semi").unionByName(secondary.join(good, "doc_id", "left_anti"))
