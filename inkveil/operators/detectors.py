"""The pattern detectors, in order of priority, and the candidates that they find in a page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import fixed
from inkveil.functions.fixed import spelled
from inkveil.functions.skim import moved, skimmed
from inkveil.functions.text import cut_at, let, occurrences, spans_from, trimmed
from inkveil.sources.scratch import written

CANDIDATE = "struct<rank:int,pat:int,type:string,s:int,e:int,value:string>"


def _any(value: Column) -> Column:
    return F.lit(True)


def is_email(value: Column) -> Column:
    """Lengths of both parts, no empty label, no label that starts or ends with a hyphen."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    bad = F.regexp_like(local, F.lit(r"^\.|\.$|\.\.")) | F.regexp_like(domain, F.lit(r"^[.-]|-$|-\.|\.-|\.\."))
    return (F.length(local) <= 64) & (F.length(domain) <= 254) & ~bad


def is_ipv4(value: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.regexp_like(value, F.lit(rf"^(?:{octet}\.){{3}}{octet}$"))


def is_ipv6(value: Column) -> Column:
    """Eight groups, or fewer around one ::."""
    groups = F.size(F.filter(F.split(value, ":", -1), lambda g: g != ""))
    gaps = F.size(F.split(value, "::", -1)) - 1
    edge = F.regexp_like(value, F.lit("^:[^:]")) | F.contains(value, F.lit(":::"))
    return ~edge & (((gaps == 0) & (groups == 8)) | ((gaps == 1) & (groups <= 7)))


def is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.regexp_like(digits, F.lit(fixed.BRANDS)) & F.call_function("luhn_check", digits)


def is_iban(value: Column) -> Column:
    """The country's length, and the remainder 1 of the rearranged digits by 97."""
    plain = F.regexp_replace(value, " ", "")
    lengths = F.create_map(*[x for k, n in fixed.IBAN_LENGTHS.items() for x in (F.lit(k), F.lit(n))])
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    digits = F.filter(F.split(turned, "", -1), lambda c: c != "")
    rest = F.aggregate(digits, F.lit(0), lambda acc, c: F.when(F.regexp_like(c, F.lit("^[0-9]$")), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return (F.coalesce(F.try_element_at(lengths, F.substring(plain, 1, 2)), F.lit(0)) == F.length(plain)) & (rest == 1)


def is_ssn(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


@dataclass(frozen=True)
class Pattern:
    """One pattern of a detector: `type` None claims its span and yields nothing; `group` 1 takes
    the captured value; `birth` asks for a birth word within the 40 characters before. Every match starts with
    `lead`, which is cheap to try before all look-arounds, and holds the text `need`."""

    rank: int
    pat: int
    type: str | None
    regex: str
    valid: Callable[[Column], Column] = _any
    group: int = 0
    birth: bool = False
    lead: str = ""
    need: str = ""

    @property
    def java(self) -> str:
        return (f"(?={self.lead})" if self.lead else "") + spelled(self.regex)


def _labelled(rank: int, pat: int, kind: str, labels: str, lead: str) -> Pattern:
    return Pattern(rank, pat, kind, fixed.LABELLED % (labels, fixed.ID_VALUE), group=1, lead=lead)


#: A digit, or the first two letters of a month.
_DATE_LEAD = r"\d|[adfjmnosADFJMNOS][aceopuACEOPU]"

DETECTORS: list[Pattern] = [
    Pattern(1, 1, "Email", fixed.EMAIL, is_email, need="@"),
    Pattern(2, 1, "IP Address", fixed.IPV4, is_ipv4, lead=r"\d", need="."),
    Pattern(2, 2, "IP Address", fixed.IPV6, is_ipv6, need=":"),
    Pattern(3, 1, "Credit Card", fixed.CARD, is_card, lead=r"\d"),
    Pattern(4, 1, "IBAN", fixed.IBAN, is_iban, lead=r"[A-Z]{2}\d"),
    Pattern(5, 1, "SSN", fixed.SSN, is_ssn, lead=r"\d{3}"),
    Pattern(6, 1, "Date of Birth", fixed.DATE, birth=True, lead=_DATE_LEAD),
    Pattern(6, 2, "Date of Birth", fixed.BIRTH_YEAR, group=1, lead="[ydbYDB]"),
    _labelled(7, 1, "Passport", fixed.PASSPORT_LABELS, "[pP][aA]"),
    _labelled(8, 1, "Visa", fixed.VISA_LABELS, "[vV][iI]"),
    _labelled(9, 1, "Case Number", fixed.CASE_LABELS, "[cfdmaCFDMA]"),
    Pattern(9, 2, "Case Number", fixed.COURT_CASE, lead=r"\d", need=":"),
    Pattern(9, 3, "Case Number", fixed.AGENCY_CASE, lead=r"\d", need="-"),
    _labelled(10, 1, "License Plate", fixed.PLATE_LABELS, "[lpLP][ilIL]"),
    _labelled(11, 1, "ID Number", fixed.ID_LABELS, "[sbidlSBIDL]"),
    Pattern(12, 1, "Person", fixed.TITLED, group=1, lead="[ACDIJMOS]"),
    Pattern(13, 1, None, fixed.DATE, lead=_DATE_LEAD),
    Pattern(14, 1, "Phone", r"(?<![A-Za-z0-9_+(.-])(?:" + fixed.PHONE + ")", lead="[+(1-9]"),
]


def has_birth_context(text: Column, at: Column) -> Column:
    """Whether one of the birth words ends within the 40 characters before `at`."""
    start = F.greatest(at - fixed.BIRTH_WINDOW, F.lit(0))
    return F.regexp_like(F.substring(text, start + 1, at - start), F.lit(spelled(fixed.BIRTH_WORDS)))


#: With more patterns than that, a text is skimmed before they search it; that takes as long as two.
SKIM_FROM = 3
#: A text of so many characters or less is searched as it is; to skim it takes longer.
SKIM_CHARS = 1024


def candidates_of(text: Column, patterns: list[Pattern] = DETECTORS, skim: Column | None = None) -> Column:
    """An array of all valid matches for each pattern, in order of position; found in skimmed(text) if that is
    given. Each pattern only cuts the text at its matches; all that follows is said once for all patterns."""
    if not patterns:
        return F.array().cast(f"array<array<{CANDIDATE}>>")
    short = text if skim is None else skim["short"]

    def hits(p: Pattern) -> Column:
        parts = cut_at(short, F.lit(p.java), p.group)
        if p.need:
            parts = F.when(F.contains(short, F.lit(p.need)), parts).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(p.rank).alias("rank"), F.lit(p.pat).alias("pat"), F.lit(p.type).cast("string").alias("type"), parts.alias("parts"))

    def fits(x: Column) -> Column:
        out = None
        for p in patterns:
            if p.valid is _any and not p.birth:
                continue
            rule = has_birth_context(text, x["s"]) if p.birth else p.valid(x["value"])
            own = (x["rank"] == p.rank) & (x["pat"] == p.pat)
            out = F.when(own, rule) if out is None else out.when(own, rule)
        return F.lit(True) if out is None else out.otherwise(True)

    def placed(h: Column) -> Column:
        def named(x: Column) -> Column:
            return F.struct(h["rank"].alias("rank"), h["pat"].alias("pat"), h["type"].alias("type"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"))

        spans = spans_from(h["parts"])
        if skim is not None:
            spans = F.transform(spans, lambda x: moved(skim["cuts"], x))
        return F.when(F.size(h["parts"]) > 1, F.filter(F.transform(spans, named), fits)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))

    return F.transform(F.array(*map(hits, patterns)), placed).cast(f"array<array<{CANDIDATE}>>")


def searched(text: Column, patterns: list[Pattern], use: Callable[[Column], Column]) -> Column:
    """`use` of the candidates of each pattern; a text without anchors isn't searched."""
    if len(patterns) <= SKIM_FROM:
        return use(candidates_of(text, patterns))
    none = F.array().cast(f"array<{CANDIDATE}>")
    cuts = F.array().cast("array<struct<at:int,gone:int>>")
    skim = F.when(F.length(text) <= SKIM_CHARS, F.struct(text.alias("short"), cuts.alias("cuts"))).otherwise(skimmed(text))
    return let(skim, lambda k: F.when(F.length(k["short"]) < 3, none).otherwise(use(candidates_of(text, patterns, k))))


def overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda a: (x["s"] < a["e"]) & (x["e"] > a["s"]))


def claimed(candidates: Column) -> Column:
    """The candidates that overlap none accepted before them; the first to claim a span wins.

    `candidates` has an array for each pattern, in order of priority. Matches of one pattern never
    overlap, so each array is held against what the patterns before it took, whole.
    """
    none = F.array().cast(f"array<{CANDIDATE}>")

    def step(taken: Column, own: Column) -> Column:
        return F.when(F.size(own) == 0, taken).otherwise(F.concat(taken, F.filter(own, lambda c: ~overlaps(c, taken))))

    return F.aggregate(candidates, none, step)


def with_claims(pages: DataFrame, patterns: list[Pattern] = DETECTORS) -> DataFrame:
    """pages plus `claims`, the accepted candidates of every page; null texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return pages.withColumn("claims", searched(text, patterns, claimed))


def claims_table(pages: DataFrame, patterns: list[Pattern] = DETECTORS) -> DataFrame:
    """(doc_id, page, claims) of all pages that have any, written to the shared folder: one search of the
    texts for all that needs the claims."""
    found = written(with_claims(pages.select("doc_id", "page", "text"), patterns).select("doc_id", "page", "claims"), "claims")
    return found.where(F.size("claims") > 0)


def claimed_rows(claims: DataFrame) -> DataFrame:
    """(doc_id, page, rank, pat, type, s, e, value) of the claims (doc_id, page, claims) with a type."""
    # An outer inline: for an inner one the optimizer would make the claims a second time, to filter by.
    return claims.select("doc_id", "page", F.inline_outer("claims")).where("type is not null").withColumn("value", trimmed(F.col("value")))


def pattern_entities(pages: DataFrame, patterns: list[Pattern] = DETECTORS) -> DataFrame:
    """claimed_rows() of pages (doc_id, page, text)."""
    return claimed_rows(with_claims(pages.select("doc_id", "page", "text"), patterns).select("doc_id", "page", "claims"))


def matches(pages: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc_id, page, type, s, e, value) of the valid matches of some detectors, unclaimed."""
    own = [p for p in DETECTORS if p.type in kinds]
    text = F.coalesce(F.col("text"), F.lit(""))
    found = pages.select("doc_id", "page", F.inline_outer(searched(text, own, F.flatten)))
    return found.where("type is not null").select("doc_id", "page", "type", "s", "e", "value")


def is_claimed(value: Column, text: Column, claims: Column) -> Column:
    """Whether the value occurs, in its own case, and each occurrence overlaps a claim."""
    return let(occurrences(value, text), lambda found: (F.size(found) > 0) & F.forall(found, lambda x: overlaps(x, claims)))
