"""Operator 10: shards by a k-d tree over document metadata, with near equal bytes.

A node with m shards is split along its widest dimension at the weighted quantile that gives its
two sides floor(m / 2) and ceil(m / 2) shards' worth of bytes. All nodes of a depth are split by
the same few aggregations: each counts bytes in `BINS` equal bins of every node's range, and the
bin that holds the quantile is binned anew until it is small enough. Only node and bin totals
reach the driver, and their number is fixed by the shard count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import text_of, written

BINS = 512
#: Bytes that a cut may be off, as a share of one shard.
SLACK = 0.002
#: A group of equal texts above this share of a shard is dealt out in parts; others stay whole.
PART = 0.25
#: Rows of a shard that are numbered together; more rows make more buckets, not larger ones.
SLOT_ROWS = 250_000
DIMENSIONS = ("d_source", "d_lang", "d_chars", "d_hash")
_SPAN = float(1 << 52)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, and the group."""
    text = text_of(docs)
    bytes_ = text.cast("binary")
    label = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"), label("source").alias("source"), label("lang").alias("lang"), F.length(text).cast("long").alias("chars"),
    )


def units(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, float]:
    """(rows with their unit, units with their bytes and dimensions in 0..1, bytes of one shard).

    A unit is a group of equal texts, or a part of one that is too large to stay whole.
    """
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.max("chars").alias("chars"))
    groups = written(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    target = total / shards
    parts = F.when(F.col("n") > 1, F.least(F.ceil(F.col("bytes") / max(target * PART, 1.0)), F.col("n"))).otherwise(1).cast("int")
    groups = groups.withColumn("parts", parts)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 52)) / _SPAN
    top = groups.agg(F.max("chars")).first()[0] or 1
    shaped = groups.select(
        "g1", "g2", "parts", (F.col("bytes") / F.col("parts")).alias("bytes"), place("source").alias("d_source"), place("lang").alias("d_lang"),
        (F.log1p("chars") / float(max(math.log1p(top), 1e-9))).alias("d_chars"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    shaped = shaped.withColumn("d_hash", F.pmod(F.xxhash64("g1", "g2", "part"), F.lit(1 << 52)) / _SPAN)
    large = groups.where("parts > 1").select("g1", "g2", "parts")
    split = rows.join(large, ["g1", "g2"], "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0).cast("int"))
    return split.drop("parts"), written(shaped, "units"), target


def _with(state: DataFrame, nodes: list[tuple], columns: list[str], how: str = "inner") -> DataFrame:
    """Rows with their node's constants, of which there is at most one row for each shard."""
    return state.join(F.broadcast(state.sparkSession.createDataFrame(nodes, ", ".join(["node int", *columns]))), "node", how)


def _key():
    """The coordinate along which a row's node is split (`dim`); equal values are told apart by the hash."""
    exact = [F.col(d) if d == "d_hash" else F.col(d) + F.col("d_hash") * 1e-7 for d in DIMENSIONS]
    return F.element_at(F.array(*exact), F.col("dim"))


def build_tree(nodes: DataFrame, shards: int, target: float) -> DataFrame:
    """(g1, g2, part, shard) of every unit. `nodes` is read, never shuffled whole, at each cut."""
    state = nodes.withColumn("node", F.lit(0))
    #: node -> (first shard, number of shards)
    open_nodes = {0: (0, shards)}
    while any(m > 1 for _, m in open_nodes.values()):
        wide = {n: v for n, v in open_nodes.items() if v[1] > 1}
        busy = _with(state, [(n,) for n in wide], []).select(state.columns)
        spread = {r["node"]: r for r in busy.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[F.min(d).alias(f"{d}_0") for d in DIMENSIONS], *[F.max(d).alias(f"{d}_1") for d in DIMENSIONS]).collect()}
        dims, low, high, goal = {}, {}, {}, {}
        for n in wide:
            if n not in spread:
                continue
            width = {d: spread[n][f"{d}_1"] - spread[n][f"{d}_0"] for d in DIMENSIONS}
            # The hash is no metadata: it only parts what metadata hardly tells apart.
            width["d_hash"] *= 0.1
            dims[n] = max(DIMENSIONS, key=lambda d: (width[d], -DIMENSIONS.index(d)))
            low[n], high[n] = spread[n][f"{dims[n]}_0"], spread[n][f"{dims[n]}_1"] + 1.1e-7
            goal[n] = spread[n]["bytes"] * (wide[n][1] // 2) / wide[n][1]
        cuts, below = {}, dict.fromkeys(dims, 0.0)
        while len(cuts) < len(dims):
            left = [n for n in dims if n not in cuts]
            bins = [(n, DIMENSIONS.index(dims[n]) + 1, float(low[n]), float(max((high[n] - low[n]) / BINS, 1e-300))) for n in left]
            keyed = _with(state, bins, ["dim int", "low double", "step double"]).withColumn("key", _key())
            inside = keyed.withColumn("place", (F.col("key") - F.col("low")) / F.col("step")).where((F.col("place") >= 0) & (F.col("place") < BINS))
            inside = inside.withColumn("bin", F.floor("place").cast("int"))
            totals: dict[int, dict[int, tuple]] = {n: {} for n in left}
            for r in inside.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect():
                totals[r["node"]][r["bin"]] = r["bytes"], r["n"], r["a"], r["z"]
            for n in left:
                run = below[n]
                for k in sorted(totals[n]):
                    size, count, a, z = totals[n][k]
                    if run + size >= goal[n]:
                        # What can't be cut further goes to the side that it leaves nearer its goal.
                        if count == 1 or z <= a or size <= SLACK * target:
                            cuts[n] = a if goal[n] - run < run + size - goal[n] else math.nextafter(z, math.inf)
                        else:
                            below[n], low[n], high[n] = run, a, z + (z - a) * 1e-6
                        break
                    run += size
                else:
                    cuts[n] = high[n]
        grown, ids = {}, {}
        for n, (first, m) in open_nodes.items():
            if m == 1 or n not in cuts:
                grown[n] = (first, 1 if n not in cuts else m)
                continue
            a, b = 2 * n + 1, 2 * n + 2
            ids[n] = (a, b)
            grown[a], grown[b] = (first, m // 2), (first + m // 2, m - m // 2)
        open_nodes = grown
        if ids:
            ways = _with(state, [(n, DIMENSIONS.index(dims[n]) + 1, float(cuts[n])) for n in ids], ["dim int", "cut double"], "left")
            lower = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + 1 + (_key() >= F.col("cut")).cast("int"))
            state = written(ways.withColumn("node", lower).select(state.columns), "nodes")
    return _with(state, [(n, first) for n, (first, _) in open_nodes.items()], ["shard int"]).select("g1", "g2", "part", "shard")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs`.

    The law is `bytes`: sizes of shards are near equal. Equal texts share a shard, unless their
    bytes together pass a quarter of a shard; then they are dealt to parts by doc_id. Null texts
    count as empty. Slots follow no order but are gapless from 0 in each shard. Rows that repeat a
    doc_id are rows of their own. An empty table gives no rows.
    """
    rows, parts, target = units(sized(docs), shards)
    where = build_tree(parts, shards, target)
    placed = rows.join(where, ["g1", "g2", "part"]).select("doc_id", "size", "text_crc32", "shard")
    placed = written(placed, "placed")
    buckets = max(1, -(-placed.count() // (shards * SLOT_ROWS)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    #: One row for each shard and bucket.
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    bases = counts.select("shard", "bucket", before.alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    out = placed.withColumn("number", number).join(bases, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the documents, one folder for each shard, from the placing of their doc_ids."""
    docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
