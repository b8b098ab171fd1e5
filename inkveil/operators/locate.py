"""Where values stand: whole-word matches of every value in the pages of its document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import find_spans, let, once, running_sums, word_pattern, words_of
from inkveil.sources.scratch import written

_RUN = r"[\p{L}\p{N}_]+"
#: Stands for the word next to a snippet; a value that holds it is looked for in whole texts.
_NEXT = "\ua66e"
#: Wanted words whose hashes are told to each page as they are; more are told as bits.
_LISTED_WORDS = 1 << 16
#: Bits for each wanted word, and their least and largest number.
_BITS_A_WORD, _LEAST_BITS, _MOST_BITS = 16, 1 << 12, 1 << 20
#: The words of a text in their plain form. Those of plain ASCII are put in lower case all at once; those of other texts
#: one by one, as some letters depend on what stands next to them.
_FOLDED = f"CASE WHEN length(text) = octet_length(text) THEN regexp_extract_all(lower(text), r'{_RUN}', 0) ELSE transform(regexp_extract_all(text, r'{_RUN}', 0), w -> lower(upper(w))) END"
_SPANS = "array<struct<s:int,e:int,value:string>>"


def _plain(text: Column) -> Column:
    return F.lower(F.upper(text))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))


def locate(values: DataFrame, pages: DataFrame, by_word: bool = False) -> DataFrame:
    """(doc_id, value, page, spans, n) of each value (doc_id, value) on each page that has it.

    Values of a document are distinct before the join. `by_word` is for documents of many pages: values then
    meet an index of the places in the pages where their words follow each other, and no text moves. Else each page of
    a document is paired with each of its values, and searched for it only if it holds the value's first word in any case.
    """
    own = values.select("doc_id", "value").distinct().withColumn("first", F.lower(F.try_element_at(words_of(F.col("value")), F.lit(1)))).where("first is not null")
    texts = pages.select("doc_id", "page", "text")
    if not by_word:
        both = own.join(texts, "doc_id").where(F.contains(F.lower("text"), F.col("first")))
        found = once(both, "spans", find_spans(F.col("text"), word_pattern(F.col("value"))))
    else:
        own = written(own, "values")
        odd = F.contains("value", F.lit(_NEXT)) | ~F.regexp_like("value", F.lit(_RUN))
        phrases = own.where(~odd).select("doc_id", "value", F.transform(_runs(F.col("value")), _plain).alias("words"))
        found = located(phrases, word_index(texts, phrases)).select("doc_id", "value", "page", "spans")
        # Texts are shuffled to meet such values, so that is left out where there are none.
        if not own.where(odd).isEmpty():
            found = found.unionByName(locate(own.where(odd), texts).select("doc_id", "value", "page", "spans"))
    return found.where(F.size("spans") > 0).select("doc_id", "value", "page", "spans", F.size("spans").cast("long").alias("n"))


def _wanted(words: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that all `n` words (w) pass, and few others: a bit for each hash of a word. The bits are bounded,
    however many words there are."""
    bits = _LEAST_BITS
    while bits < min(_MOST_BITS, n * _BITS_A_WORD):
        bits *= 2
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(bits)).cast("int")
    rows = words.select(place(F.col("w")).alias("p")).distinct().groupBy((F.col("p") / 32).cast("int").alias("k")).agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 32)).alias("x"))
    cells = [0] * (bits // 32)
    for r in rows.collect():
        cells[r["k"]] = r["x"]
    table = F.expr("array(" + ", ".join(f"{x}L" for x in cells) + ")")
    return lambda w: let(place(w), lambda p: F.element_at(table, (p / 32).cast("int") + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p % 32)) != 0)


def _sized(n: Column, word: Column) -> Column:
    """Names the phrases of n words that start with a word."""
    return F.concat(n.cast("string"), F.lit(" "), word)


def _of(doc: Column, phrase: Column) -> Column:
    """Names a phrase of a document."""
    return F.concat(doc.cast("string"), F.lit(" "), phrase)


def word_index(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, page, at) of the pages where words follow each other as in a phrase (doc_id, value, words) of their document.

    at: each such place in order: phrase (the words in their plain form, with blanks), n (their number), s (the offset of
    the first one), shown (the words and what stands around them, with the mark _NEXT in place of the words next to
    them) and lead (what of `shown` stands before the first word). A page's words are held against the phrases' first
    words; only where one stands, those that follow are held against the phrases. Few places of other phrases are among
    them.
    """
    known = written(phrases.select("doc_id", F.size("words").alias("n"), F.element_at("words", 1).alias("first"), F.array_join("words", " ").alias("phrase")).distinct(), "phrases")
    firsts = known.select(F.col("first").alias("w")).distinct()
    n_firsts = firsts.count()
    keys = known.select(_of(F.col("doc_id"), F.col("phrase")).alias("w")).unionByName(known.select(_sized(F.col("n"), F.col("first")).alias("w")).distinct())
    wanted = _wanted(keys, known.count())
    sizes = F.array(*[F.lit(r["n"]) for r in known.select("n").distinct().orderBy("n").collect()]).cast("array<int>")
    text = F.col("text")

    starts = "NULL"
    if n_firsts <= _LISTED_WORDS:
        # Said in SQL, which takes a long list at once.
        hashes = ", ".join(str(r["h"]) for r in firsts.select(F.hash("w").alias("h")).distinct().collect())
        starts = f"filter(sequence(1, size(words)), k -> hash(element_at(words, k)) IN ({hashes or 'NULL'}))"
    begun = F.expr(f"element_at(transform(array({_FOLDED}), words -> struct(words, CASE WHEN size(words) > 0 THEN {starts} END AS starts)), 1)")
    if n_firsts > _LISTED_WORDS:
        first = _wanted(firsts, n_firsts)
        own = lambda words: F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: first(F.element_at(words, k)))
        begun = let(begun["words"], lambda words: F.struct(words.alias("words"), F.when(F.size(words) > 0, own(words)).alias("starts")))

    def hits(words: Column, starts: Column) -> Column:
        n = F.size(words)

        def at(k: Column) -> Column:
            own = F.filter(sizes, lambda m: (k + m - 1 <= n) & wanted(_sized(m, F.element_at(words, k))))
            made = F.transform(own, lambda m: F.struct(k.alias("pos"), m.alias("n"), F.array_join(F.slice(words, k, m), " ").alias("phrase")))
            return F.filter(made, lambda x: wanted(_of(F.col("doc_id"), x["phrase"])))

        return F.flatten(F.transform(starts, at))

    def ends(x: Column) -> Column:
        """Where the first words of the hits end: lengths are added up from one of them to the next, and only these are
        summed on."""
        lengths = F.zip_with(x["words"], F.slice(x["gaps"], F.lit(1), F.size(x["words"])), lambda w, g: F.length(w) + F.length(g))

        def step(lengths: Column) -> Column:
            def since(h: Column, i: Column) -> Column:
                last = F.when(i > 0, F.get(x["hits"], i - 1)["pos"]).otherwise(0)
                return F.aggregate(F.slice(lengths, last + 1, h["pos"] - last), F.lit(0), lambda a, b: a + b)

            return F.transform(x["hits"], since)

        return running_sums(let(lengths, step))

    def shown(x: Column) -> Column:
        words, gaps = x["words"], x["gaps"]

        def place(h: Column, end: Column) -> Column:
            k, n = h["pos"], h["n"]
            before = F.concat(F.when(k > 1, _NEXT).otherwise(""), F.element_at(gaps, k))
            rest = F.array_join(F.zip_with(F.slice(words, k, n), F.slice(gaps, k + 1, n), lambda w, g: F.concat(w, g)), "")
            after = F.when(k + n - 1 < F.size(words), _NEXT).otherwise("")
            return F.struct(h["phrase"].alias("phrase"), n.alias("n"), (end - F.length(F.element_at(words, k))).alias("s"), F.concat(before, rest, after).alias("shown"), F.length(before).alias("lead"))

        return F.zip_with(x["hits"], ends(x), place)

    none = F.array().cast("array<struct<phrase:string,n:int,s:int,shown:string,lead:int>>")
    parts = lambda h: F.struct(h.alias("hits"), _runs(text).alias("words"), F.split(text, _RUN, -1).alias("gaps"))
    found = let(begun, lambda x: F.when(F.size(x["starts"]) > 0, hits(x["words"], x["starts"])))
    at = let(found, lambda h: F.when(F.size(h) > 0, let(parts(h), shown)).otherwise(none))
    rows = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.select("doc_id", "page", at.alias("at")), "index").where(F.size("at") > 0)


def located(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, value, page, spans) of the phrases (doc_id, value, words) in the pages of an index.

    A phrase meets the places of just its words, whatever their number. There the value's pattern decides on them and
    on what stands around them, which is all that it can match.
    """
    places = index.select("doc_id", "page", F.inline("at"))
    rows = phrases.select("doc_id", "value", F.array_join("words", " ").alias("phrase")).join(places, ["doc_id", "phrase"])
    pattern = word_pattern(F.col("value"))

    def matched(p: Column) -> Column:
        place = F.col("s") - F.col("lead") + F.regexp_instr(F.col("shown"), p) - 1
        value = F.regexp_substr(F.col("shown"), p)
        return F.struct(place.alias("s"), (place + F.length(value)).alias("e"), value.alias("value"))

    hits = once(rows, "hit", let(pattern, matched)).where("hit.value is not null")
    found = F.array_sort(F.collect_list("hit")).cast(_SPANS)
    spans = hits.groupBy("doc_id", "value", "page").agg(found.alias("found"))
    # Of matches that overlap the first one stands, as in a search from left to right.
    apart = lambda acc, x: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(0)) > x["s"]), acc).otherwise(F.concat(acc, F.array(x)))
    meet = F.exists(F.zip_with("found", F.slice("found", 2, F.size("found")), lambda x, y: F.coalesce(x["e"] > y["s"], F.lit(False))), lambda x: x)
    kept = F.when(meet, F.aggregate("found", F.array().cast(_SPANS), apart)).otherwise(F.col("found"))
    return spans.select("doc_id", "value", "page", kept.alias("spans"))


def match_summary(matches: DataFrame) -> DataFrame:
    """(doc_id, value, pages, count): pages in order, and all matches together."""
    return matches.groupBy("doc_id", "value").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.sum("n").alias("count"))
