"""Text functions: spans of patterns, white space, keys, cleaning, chunks, whole words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.fixed import CAPS_RUN, CAPS_WORD, CHUNK_WORDS, NOISE, OVERLAP_WORDS, WS, spelled

_S = f"[{WS}]"
SPAN = "struct<s:int,e:int,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once for a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows plus `name`, which is made once. Of a plain column the optimizer puts what makes it into each filter that
    follows; it doesn't for an outer explode of one value."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_S}+|{_S}+$", "")


def words_of(text: Column) -> Column:
    """The words between white space, none of them empty."""
    return F.filter(F.split(text, f"{_S}+", -1), lambda w: w != "")


def value_key(value: Column) -> Column:
    """Identity of a value: trimmed, white space made single blanks, in lower case."""
    return F.lower(F.regexp_replace(trimmed(value), f"{_S}+", " "))


#: Elements that running_sums adds up at once.
_RUN = 256


def running_sums(values: Column) -> Column:
    """Running sums of an array of integers that isn't empty."""
    return running(values, lambda a, b: a + b)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of `join`, which starts from 0, over an array of integers that isn't empty. They are made in
    stretches of _RUN elements, so that no long array is copied for every element."""
    none = F.array().cast("array<int>")

    def sums(own: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), none.alias("out"))
        step = lambda acc, x: let(join(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))
        return F.aggregate(own, start, step, lambda acc: acc["out"])

    def of(own: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _RUN).cast("int")), lambda k: F.slice(own, k * _RUN + 1, F.lit(_RUN)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

        def step(acc: Column, part: Column) -> Column:
            return let(sums(part, acc["at"]), lambda own: F.struct(F.element_at(own, -1).alias("at"), F.concat(acc["out"], F.array(own)).alias("out")))

        return F.flatten(F.aggregate(stretches, start, step, lambda acc: acc["out"]))

    return let(values, of)


#: Stands around matches while a text is cut at them.
_MARK = "\u0000"


def cut_at(text: Column, regex: Column, group: int = 0) -> Column:
    """[gap, match, value, gap, match, value, ..., gap] of a text and a pattern; value is the match, or the group of it
    that ends it. One pass over the text makes them all, but for a text that holds the mark itself."""
    marked = F.split(F.regexp_replace(text, regex, F.lit(f"{_MARK}$0{_MARK}${group}{_MARK}")), _MARK, -1)
    m, v, gaps = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(group)), F.split(text, regex, -1)
    single = F.concat(F.flatten(F.transform(m, lambda x, k: F.array(F.get(gaps, k), x, F.get(v, k)))), F.array(F.element_at(gaps, -1)))
    return F.when(F.contains(text, F.lit(_MARK)), single).otherwise(marked)


def spans_from(parts: Column) -> Column:
    """(s, e, value) of what cut_at() gave, with one match at least."""
    own = F.sequence(F.lit(0), F.size(parts) - 2, F.lit(3))
    ends = running_sums(F.transform(own, lambda k: F.length(F.get(parts, k)) + F.length(F.get(parts, k + 1))))
    return F.zip_with(own, ends, lambda k, e: let(F.get(parts, k + 2), lambda v: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("value"))))


def find_spans(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches in turn as structs (s, e, value), in code points from 0.

    `group` 1 gives the captured value instead, which must end the match.
    """
    parts = cut_at(text, F.lit(pattern) if isinstance(pattern, str) else pattern, group)
    return let(parts, lambda x: F.when(F.size(x) > 1, spans_from(x)).otherwise(F.array().cast(f"array<{SPAN}>")))


def quoted(words: Column) -> Column:
    """Words as patterns that match just them."""
    return F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))


def occurrences(value: Column, text: Column) -> Column:
    """Where the value stands in the text in its own case, overlapping places too: (s, e) structs."""
    first, rest = F.substring(value, 1, 1), F.substring(value, 2, 1 << 30)
    pattern = F.concat(F.element_at(quoted(F.array(first)), 1), F.lit("(?="), F.element_at(quoted(F.array(rest)), 1), F.lit(")"))
    places = F.transform(find_spans(text, pattern), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(value)).alias("e")))
    return F.when((F.length(value) > 0) & F.contains(text, value), places).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def word_pattern(value: Column) -> Column:
    """A pattern that finds the value as a whole, whatever its case and white space. Its first word is tried before the
    look-behind, which is dear."""

    def of(words: Column) -> Column:
        first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
        return F.concat(F.lit("(?iu)(?="), first, F.lit(r")(?<![\p{L}\p{N}_])"), F.array_join(words, f"{_S}+"), F.lit(r"(?![\p{L}\p{N}_])"))

    return let(quoted(words_of(value)), of)


def appears(value: Column, text: Column) -> Column:
    """Whether the value occurs in the text as a whole word. A value without words doesn't."""
    first = F.lower(F.element_at(words_of(value), 1))
    return F.when(F.size(words_of(value)) == 0, False).otherwise(F.contains(F.lower(text), first) & F.regexp_like(text, word_pattern(value)))


def stitched(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of the pattern changed, and what stands between them as it is."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, F.concat(F.transform(hits, change), F.array(F.lit(""))), lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    return F.array_join(pairs, "")


def title_case_caps(line: Column) -> Column:
    """Runs of two or more words in capitals, in title case: each group of letters by itself."""
    titled = lambda w: F.concat(F.left(w, F.lit(1)), F.lower(F.substring(w, 2, 1 << 20)))
    return stitched(line, spelled(CAPS_RUN), lambda r: stitched(r, CAPS_WORD, titled))


def clean_for_model(text: Column) -> Column:
    """The text as a tagger gets it: no links, time stamps, log ids or tags; only lines with words."""

    def clean(line: Column) -> Column:
        for pattern in NOISE:
            line = F.regexp_replace(line, spelled(pattern), "")
        return title_case_caps(line)

    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), clean), lambda x: F.regexp_like(x, F.lit("[a-zA-Z]{2,}"))), "\n")


def chunk_words(text: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Overlapping chunks of `size` words; the last one is the first that reaches the end."""
    step = size - overlap

    def chunks(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - size) / F.lit(float(step))), F.lit(0)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " "))
        return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(words_of(text), chunks)


def page_list(pages: Column) -> Column:
    """'Page 3', 'Pages 1, 2 and 3'; empty for none."""
    text = F.transform(pages, lambda p: p.cast("string"))
    n = F.size(pages)
    many = F.concat(F.lit("Pages "), F.array_join(F.slice(text, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(text, F.lit(-1)))
    return F.when(n == 1, F.concat(F.lit("Page "), F.try_element_at(text, F.lit(1)))).when(n > 1, many).otherwise("")


def removal_sentence(kinds: Column) -> Column:
    """'Removed: a, b and c.', or that nothing was found."""
    n = F.size(kinds)
    many = F.concat(F.array_join(F.slice(kinds, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(kinds, F.lit(-1)))
    listed = F.when(n == 1, F.try_element_at(kinds, F.lit(1))).otherwise(many)
    return F.when(n > 0, F.concat(F.lit("Removed: "), listed, F.lit("."))).otherwise("No personal details found.")
