"""Operator 13: hard negatives, by best-first search in a sort-tile-recursive packed R-tree.

Rows are sorted and tiled on the widest coordinates, first by Spark into shards of a bounded number of
rows, then within each shard into leaves and nodes, each with its bounding box. A box gives an interval
for every coordinate, and so one for the inner product with an anchor. Anchors stay in blocks by shard:
each block first searches its own shard, which bounds what is worth finding, and then those other shards
whose boxes aren't ruled out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import written

ANCHOR_EVERY = 50
N_POSITIVES, N_NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a shard, of a leaf, and children of a node.
SHARD_ROWS, LEAF_ROWS, FANOUT = 8192, 512, 8
#: Components beyond this count as it, so that scores are exact in 64 bits.
LIMIT = 1 << 24
_OUT = "anchor_id long, label long, positive_id long, positive_score long, id long, score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(id, label, v, r) of the rows that take part: labels as dealt, components as integers, and a number
    from 0 to 1 that depends on the id and breaks ties of coordinates."""
    fine = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding")).where(fine).where("id is not null")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.lit(256.0) * F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return rows.select("id", label.alias("label"), v.alias("v"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("r"))


def _place(value: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < value))


def _cuts(parts: int) -> list[float]:
    return [k / parts for k in range(1, parts)] or [0.5]


def shards_of(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows plus `shard`: slabs on the widest coordinate, each cut into tiles on the next one.

    Coordinates are made distinct by `r`, so equal vectors don't crowd into one shard.
    """
    n = rows.count()
    parts = max(1, math.ceil(n / shard_rows))
    spread = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.var_pop(F.col("x").cast("double")).alias("s")).orderBy(F.desc("s"), "k").limit(2).collect()
    if parts == 1 or not spread:
        return rows.withColumn("shard", F.lit(0))
    first, second = spread[0]["k"], spread[-1]["k"]
    at = lambda k: F.coalesce(F.try_element_at("v", F.lit(k + 1)), F.lit(0)) + F.col("r")
    slabs = math.ceil(math.sqrt(parts))
    tiles = math.ceil(parts / slabs)
    edges = rows.agg(F.percentile_approx(at(first), _cuts(slabs), 100_000).alias("e")).first()["e"]
    rows = rows.withColumn("slab", _place(at(first), F.array(*map(F.lit, edges))) if slabs > 1 else F.lit(0))
    own = rows.groupBy("slab").agg(F.percentile_approx(at(second), _cuts(tiles), 10_000).alias("edges"))
    rows = rows.join(own, "slab")
    return rows.withColumn("shard", (F.col("slab") * tiles + (_place(at(second), F.col("edges")) if tiles > 1 else F.lit(0))).cast("int")).drop("slab", "edges")


def packed_order(v: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows whose consecutive `leaf` rows are tiles: sorted by the widest coordinate, cut into
    slabs of whole leaves, and each slab sorted and cut anew."""

    def tile(own: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = math.ceil(len(own) / leaf)
        if leaves <= 1:
            return [own]
        wide = int((v[own].max(0) - v[own].min(0)).argmax())
        own = own[np.argsort(v[own, wide], kind="stable")]
        slabs = 2 if depth else math.ceil(math.sqrt(leaves))
        size = math.ceil(leaves / slabs) * leaf
        return [x for at in range(0, len(own), size) for x in tile(own[at : at + size], depth + 1)]

    return np.concatenate(tile(np.arange(len(v)), 0)) if len(v) else np.arange(0)


def packed(rows: DataFrame) -> DataFrame:
    """One row for each shard: shard, its n rows in packed order (ids, labels, vectors as bytes), its box
    (low, high) and its dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def made() -> pa.RecordBatch:
            ids, labels = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (1, 2))
            lists = [x for b in held for x in b.column(3).to_pylist()]
            dims = max(map(len, lists))
            v = np.zeros((len(lists), dims), np.int64)
            for k, x in enumerate(lists):
                v[k, : len(x)] = x
            order = packed_order(v, LEAF_ROWS)
            v = v[order]
            blobs = [x.tobytes() for x in (ids[order].astype("<i8"), labels[order].astype("<i8"), v.astype("<i4"), v.min(0).astype("<i4"), v.max(0).astype("<i4"))]
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([len(v)], pa.int32()), pa.array([dims], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], ["shard", "n", "dims", "ids", "labels", "vectors", "low", "high"])

        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
            for a, b in zip(starts, starts[1:]):
                if held and shards[a] != last:
                    yield made()
                    held = []
                held.append(batch.slice(a, b - a))
                last = int(shards[a])
        if held:
            yield made()

    dealt = rows.select("shard", "id", "label", "v").repartition("shard").sortWithinPartitions("shard", "id")
    return dealt.mapInArrow(run, "shard int, n int, dims int, ids binary, labels binary, vectors binary, low binary, high binary")


def _wide(v: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, dims - v.shape[1]))) if v.shape[1] < dims else v


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every sum of a @ b.T is exact in floating point."""
    return bool(a.size and b.size) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly."""
    if _fits(a, b):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def intervals(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of each row of `a` with anything in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _product(up, low) + _product(down, high), _product(up, high) + _product(down, low)


class Tree:
    """The packed R-tree of a shard: leaves of LEAF_ROWS rows, nodes of FANOUT children above them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        starts = np.arange(0, len(v), LEAF_ROWS)
        self.levels = [(np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts))]
        while len(self.levels[-1][0]) > FANOUT:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def search(self, anchors: np.ndarray, windows: list[list[list]], wants) -> None:
        """For each anchor, the best rows of each of its windows.

        A window is [low, high, k, found], found being a heap of (score, -id) of the k best so far.
        wants(i, labels, ids) says which rows, by their labels and ids, suit anchor i.
        """
        bounds = [[x.tolist() for x in intervals(anchors, low, high)] for low, high in self.levels]
        kind = np.float64 if _fits(anchors, self.v) else np.int64
        rows_of, own, scored = self.v.astype(kind), anchors.T.astype(kind), {}
        top = len(self.levels) - 1
        for i, asked in enumerate(windows):
            least, most = [b[0][i] for b in bounds], [b[1][i] for b in bounds]
            queue = [(-x, top, k) for k, x in enumerate(most[top])]
            heapq.heapify(queue)
            while queue:
                upper, level, k = heapq.heappop(queue)
                upper, lower = -upper, least[level][k]
                open_ = [w for w in asked if upper >= w[0] and lower <= w[1] and not (len(w[3]) == w[2] and upper < w[3][0][0])]
                if not open_:
                    continue
                if level:
                    for child in range(k * FANOUT, min((k + 1) * FANOUT, len(most[level - 1]))):
                        heapq.heappush(queue, (-most[level - 1][child], level - 1, child))
                    continue
                at = k * LEAF_ROWS
                if k not in scored:
                    # A leaf that one anchor opens is scored for the whole block.
                    scored[k] = np.ascontiguousarray((rows_of[at : at + LEAF_ROWS] @ own).T)
                scores = scored[k][i]
                floor = min(max(w[0], w[3][0][0]) if len(w[3]) == w[2] else w[0] for w in open_)
                near = (scores >= floor).nonzero()[0]
                if not len(near):
                    continue
                ids = self.ids[at + near]
                suits = wants(i, self.labels[at + near], ids)
                for score, number in zip(scores[near[suits]].tolist(), ids[suits].tolist()):
                    item = (int(score), -number)
                    for low, high, size, found in open_:
                        if low <= score <= high:
                            if len(found) < size:
                                heapq.heappush(found, item)
                            elif item > found[0]:
                                heapq.heapreplace(found, item)


def _tree(row: dict, dims: int) -> Tree:
    v = np.frombuffer(row["vectors"], "<i4").reshape(row["n"], row["dims"]).astype(np.int64)
    return Tree(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), _wide(v, dims))


def _window(score: int) -> tuple[int, int]:
    """The scores of negatives for a positive's score: LOW * p <= 100 * s <= HIGH * p."""
    return -((-LOW * score) // 100), (HIGH * score) // 100


_ALL = (-(1 << 62), 1 << 62)


def searched(pairs: DataFrame, negatives: bool) -> DataFrame:
    """The best rows of a shard for each anchor of a block.

    pairs: a shard's columns, and `anchors`, an array of (id, label, v, asks), asks being the (id, score) of
    an anchor's positives; for positives, null or the least score that is still wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors = row["anchors"]
                dims = max([row["dims"], *(len(a["v"]) for a in anchors)])
                own = np.zeros((len(anchors), dims), np.int64)
                for k, a in enumerate(anchors):
                    own[k, : len(a["v"])] = a["v"]
                if negatives:
                    windows = [[[*_window(p["score"]), N_NEGATIVES, []] for p in a["asks"]] for a in anchors]
                    wants = lambda i, labels, ids: labels != anchors[i]["label"]
                else:
                    windows = [[[a["asks"][0]["score"] if a["asks"] else _ALL[0], _ALL[1], N_POSITIVES, []]] for a in anchors]
                    wants = lambda i, labels, ids: (labels == anchors[i]["label"]) & (ids != anchors[i]["id"])
                _tree(row, dims).search(own, windows, wants)
                out = [(a["id"], a["label"], p["id"] if negatives else None, p["score"] if negatives else None, -found, score) for a, ws in zip(anchors, windows) for p, w in zip(a["asks"] if negatives else [None], ws) for score, found in w[3]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, ["anchor_id", "label", "positive_id", "positive_score", "id", "score"])

    return pairs.mapInArrow(run, _OUT)


def _kept(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _possible(blocks: DataFrame, boxes: DataFrame, negatives: bool) -> DataFrame:
    """(block, shard) where an anchor of the block may find something in the shard's box.

    blocks: block, anchors; boxes: shard, dims, low, high. Blocks are held against groups of boxes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                anchors, own = row["anchors"], row["boxes"]
                dims = max([*(b["dims"] for b in own), *(len(a["v"]) for a in anchors)])
                v = np.zeros((len(anchors), dims), np.int64)
                for k, a in enumerate(anchors):
                    v[k, : len(a["v"])] = a["v"]
                low, high = (np.array([np.pad(np.frombuffer(b[c], "<i4"), (0, dims - b["dims"])) for b in own], np.int64) for c in ("low", "high"))
                least, most = intervals(v, low, high)
                asks = [[_window(p["score"]) for p in a["asks"]] if negatives else [(a["asks"][0]["score"], _ALL[1])] if a["asks"] else [_ALL] for a in anchors]
                some = np.zeros(len(own), bool)
                for k, ws in enumerate(asks):
                    for a, b in ws:
                        some |= (most[k] >= a) & (least[k] <= b)
                out += [(row["block"], own[k]["shard"]) for k in np.flatnonzero(some).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32()) for k in (0, 1)], ["block", "shard"])

    groups = boxes.groupBy((F.col("shard") / F.lit(64)).cast("int").alias("group")).agg(F.collect_list(F.struct("shard", "dims", "low", "high")).alias("boxes"))
    last = boxes.agg(F.max("shard")).first()[0] or 0
    dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(int(last) // 64))))
    return dealt.join(groups, "group").select("block", "anchors", "boxes").mapInArrow(run, "block int, shard int")


def _blocks(anchors: DataFrame) -> DataFrame:
    """(block, anchors): the anchors of a shard together."""
    return anchors.groupBy("shard").agg(F.collect_list(F.struct("id", "label", "v", "asks")).alias("anchors")).withColumnRenamed("shard", "block")


def _best(anchors: DataFrame, tree: DataFrame, negatives: bool) -> DataFrame:
    """searched() for all anchors (shard, id, label, v, asks) in all shards that may hold something."""
    blocks = written(_blocks(anchors), "blocks")
    pairs = _possible(blocks, tree.select("shard", "dims", "low", "high"), negatives)
    both = pairs.join(blocks, "block").join(tree, "shard").select("n", "dims", "ids", "labels", "vectors", "anchors")
    return searched(both, negatives)


def hard_negatives(vectors: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Ties go to
    the smaller vec_id; rows that repeat a vec_id each count, but none is its own positive. Of vectors of
    different length the shorter one counts as ending in zeros. An empty table gives no rows.
    """
    rows = written(shards_of(whole_vectors(vectors)), "vectors")
    tree = written(packed(rows), "tree")
    none = F.array().cast("array<struct<id:long,score:long>>")
    anchors = rows.where(F.col("id") % every == 0).select("shard", "id", "label", "v", none.alias("asks")).dropDuplicates(["id", "label", "v"])
    # The fifth best of an anchor's own shard is the least that another shard has to offer.
    home = tree.join(_blocks(anchors).withColumnRenamed("block", "shard"), "shard").select("n", "dims", "ids", "labels", "vectors", "anchors")
    first = _kept(searched(home, False), ["anchor_id"], N_POSITIVES).groupBy("anchor_id", "label").agg(F.min("score").alias("score"), F.count("*").alias("k")).where(F.col("k") == N_POSITIVES)
    ask = F.when(F.col("score").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("id"), "score"))).otherwise(none)
    asking = anchors.drop("asks").join(first.select(F.col("anchor_id").alias("id"), "label", "score"), ["id", "label"], "left").select("shard", "id", "label", "v", ask.alias("asks"))
    positives = _kept(_best(asking, tree, False), ["anchor_id", "label"], N_POSITIVES)
    asks = positives.groupBy("anchor_id", "label").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("asks"))
    asking = anchors.drop("asks").join(asks.withColumnRenamed("anchor_id", "id"), ["id", "label"]).select("shard", "id", "label", "v", "asks")
    found = _kept(_best(written(asking, "asking"), tree, True), ["anchor_id", "label", "positive_id"], N_NEGATIVES)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) x WHERE k <= 5),
n AS (
  SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3
"""
