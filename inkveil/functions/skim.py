"""Leaves out of a text what no detector can match in, so that the patterns meet little of it.

Every match of a detector holds an anchor: a digit, an @ or a colon, or a title before a blank. Around
its anchors a match has at most BEFORE words before and AFTER words after it; between them stand single
white space or marks that are anchors themselves. So long stretches between anchors can go: a match lies
within what stays, and what stays is cut at blanks only, where all look-arounds see the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.fixed import HONORIFICS, spelled
from inkveil.functions.text import find_spans, let, running_sums

#: Words of a match before its first anchor ("year of birth"), and after its last one (groups of an IBAN).
BEFORE, AFTER = 3, 8
#: No anchor starts with a small letter, which is what most places of a text hold.
ANCHOR = spelled(r"(?![a-z])(?:[0-9@:]+|[{WS}]{2,}|(?<=[{WS}])[#().]+(?=[{WS}])|{B}(?:" + HONORIFICS + r")\.?(?=[ \t]))")
#: Stand for the ends of an anchor, and for what was left out. Texts that hold them are searched whole.
_END, _CUT = "\u0000", "\u0001"
SKIMMED = "struct<short:string,cuts:array<struct<at:int,gone:int>>>"


def skimmed(text: Column) -> Column:
    """struct(short, cuts): the text without long stretches that hold no anchor, each of which is one
    character of `short` instead; cuts has their places in `short` and how many characters less it has."""
    none = F.array().cast("array<struct<at:int,gone:int>>")

    def kept(pieces: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            head = F.when(i > 0, F.substring_index(p, " ", AFTER + 1)).otherwise("")
            tail = F.when(i < F.size(pieces) - 1, F.substring_index(p, " ", -BEFORE - 1)).otherwise("")

            def cut(x: Column) -> Column:
                gone = F.length(p) - F.length(x["head"]) - F.length(x["tail"]) - 1
                whole = F.struct(p.alias("text"), F.lit(0).alias("at"), F.lit(0).alias("gone"))
                return F.when(gone <= 0, whole).otherwise(F.struct(F.concat(x["head"], F.lit(_CUT), x["tail"]).alias("text"), F.length(x["tail"]).alias("at"), gone.alias("gone")))

            return F.when(i % 2 == 1, F.struct(p.alias("text"), F.lit(0).alias("at"), F.lit(0).alias("gone"))).otherwise(let(F.struct(head.alias("head"), tail.alias("tail")), cut))

        return F.transform(pieces, part)

    def joined(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda x: F.length(x["text"])))
        cuts = F.filter(F.zip_with(ends, parts, lambda e, x: F.struct((e - x["at"] - 1).alias("at"), x["gone"].alias("gone"))), lambda x: x["gone"] > 0)
        return F.struct(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("short"), cuts.alias("cuts"))

    pieces = F.split(F.regexp_replace(text, ANCHOR, f"{_END}$0{_END}"), _END, -1)
    odd = F.contains(text, F.lit(_END)) | F.contains(text, F.lit(_CUT))
    return F.when(odd, F.struct(text.alias("short"), none.alias("cuts"))).otherwise(let(let(pieces, kept), joined)).cast(SKIMMED)


def moved(cuts: Column, span: Column) -> Column:
    """A span (s, e, value) of `short` where it stands in the whole text."""
    gone = F.aggregate(F.filter(cuts, lambda c: c["at"] < span["s"]), F.lit(0), lambda acc, c: acc + c["gone"])
    return let(gone, lambda by: F.struct((span["s"] + by).alias("s"), (span["e"] + by).alias("e"), span["value"].alias("value")))


def spans_in(skim: Column, pattern: str, group: int = 0) -> Column:
    """find_spans() of the whole text, found in what was kept of it."""
    return F.transform(find_spans(skim["short"], pattern, group), lambda x: moved(skim["cuts"], x))
