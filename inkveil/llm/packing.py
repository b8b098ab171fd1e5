"""Operator 6: best-fit packing of documents into sequences, under conflicts.

Bins are kept in order of the room that they have left, with bitmaps of the sources and duplicate
clusters that they hold. Items come longest first; the search starts at the tightest room that
fits and goes on to the next until it finds a bin whose bitmaps don't conflict.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import text_of, written

#: Items that are packed together by one task; more items make more groups, not larger ones.
GROUP_ITEMS = 8192
#: Items equal in all their columns that go to a group together.
ALIKE = 64


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each item; no bin holds two items of a source or of a cluster.

    Lengths are 0 to `capacity`; sources and clusters are small numbers, -1 for none, which
    conflicts with nothing.
    """
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    held: list[int] = []
    #: For each room, the bins that have it, by their bitmap of sources; bit r: some bin has room r.
    rooms: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
    taken = 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        source = 1 << sources[k] if sources[k] >= 0 else 0
        cluster = 1 << clusters[k] if clusters[k] >= 0 else 0
        found, left, sets = -1, taken >> lengths[k], 0
        room = lengths[k]
        while left and found < 0:
            skip = (left & -left).bit_length() - 1
            room, left = room + skip, left >> skip
            for sets, own in rooms[room].items():
                if not sets & source:
                    at = next((j for j, b in enumerate(own) if not held[b] & cluster), -1)
                    if at >= 0:
                        found = own.pop(at)
                        if not own:
                            del rooms[room][sets]
                            if not rooms[room]:
                                taken &= ~(1 << room)
                        break
            else:
                room, left = room + 1, left >> 1
        if found < 0:
            found, room, sets = len(held), capacity, 0
            held.append(0)
        bins[k], offsets[k] = found, capacity - room
        held[found] |= cluster
        room -= lengths[k]
        rooms[room].setdefault(sets | source, []).append(found)
        taken |= 1 << room
    return bins, offsets


def packed(items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Packs (doc_id, length, source, cluster): doc_id, piece, start, n_tokens, bin, bin_offset.

    A document longer than `capacity` is cut into pieces: full ones, which fill a bin each, and a
    rest that is packed with the others. Null or negative lengths count as 0; every document has
    at least one piece. A null source or cluster conflicts with nothing. Items are dealt to groups
    by a hash of all their columns, so that no source or cluster gathers in one task, and the
    packing is the same however the table is split; bins are the group's own. Items that are
    equal in all columns are counted, and dealt ALIKE at a time. Of items of equal length the one
    first by doc_id, piece, source and cluster is packed first.
    """
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    rows = items.select(items["doc_id"].cast("long").alias("doc_id"), length.alias("length"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"))
    pieces = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    rows = rows.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("n_tokens", F.least(F.col("length") - F.col("start"), F.lit(capacity)).cast("int"))
    item = ["doc_id", "piece", "start", "n_tokens", "source", "cluster"]
    rows = written(rows.groupBy(*item).agg(F.count("*").alias("times")), "items")
    groups = max(1, -(-(rows.agg(F.sum("times")).first()[0] or 0) // group_items))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {ALIKE}"))))
    rows = rows.withColumn("times", F.least(F.col("times") - F.col("share") * ALIKE, F.lit(ALIKE)).cast("int"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(*item, "share"), F.lit(groups)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.loc[part.index.repeat(part["times"])].sort_values(["doc_id", "piece", "source", "cluster"], kind="stable", ignore_index=True)
        sources, clusters = (pd.factorize(part[c])[0].tolist() for c in ("source", "cluster"))
        bins, offsets = best_fit(part["n_tokens"].tolist(), sources, clusters, capacity)
        out = part[["doc_id", "piece", "start", "n_tokens"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin"] = part["grp"].iloc[0] * (1 << 24) + pd.Series(bins, index=out.index)
        out["bin_offset"] = offsets
        return out

    return rows.groupBy("grp").applyInPandas(pack, "doc_id long, piece int, start long, n_tokens int, bin long, bin_offset int")


def document_items(docs: DataFrame) -> DataFrame:
    """The items of documents: length is the number of words and one end mark; a cluster holds the
    texts that are equal in lower case and with white space made single blanks.

    Null and empty texts have length 1 and are one cluster; a null source, or no such column, is
    none. Rows that repeat are items of their own; an empty table gives none."""
    text = text_of(docs)
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).alias("length"), source.alias("source"), F.xxhash64(plain).alias("cluster"))
