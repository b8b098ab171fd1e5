"""Operator 5: near-duplicate vectors by random hyperplanes, exact cosine and components.

Each table of hyperplanes deals ids and short sign sketches to its buckets. Only vectors that have
a possible partner in a bucket are dealt there themselves; pairs are then decided exactly. A block
of a bucket gives the links' number for each vector and a forest that spans them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.buckets import compare, in_blocks
from inkveil.llm.common import written
from inkveil.llm.components import connected_components

SEED = 7
#: Chance, at most, that a pair of exactly the least similarity shares a bucket in no table.
MISS = 1e-8
#: Signs in a sketch, and the standard deviations that a pair at the least similarity may differ
#: above what is expected and still be compared exactly.
SKETCH = 128
DEVIATIONS = 6.0
#: Vectors of one label that a bucket should hold on average.
BUCKET_ROWS = 32


def tables_for(largest_label: int, least: float) -> tuple[int, int]:
    """Bits of a table and number of tables, so that a pair at `least` is missed at odds of MISS."""
    bits = min(24, max(6, round(math.log2(max(largest_label / BUCKET_ROWS, 1)))))
    agree = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-agree)))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, label, embedding, n) of the equal vectors of a label that can link at all, and the
    class of each row: vec_id, cls (null where a vector links with nothing)."""
    fine = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<float>").alias("embedding"))
    # Adding zero makes -0.0 equal to 0.0, as it is for the cosine.
    rows = rows.withColumn("fine", F.expr(fine)).withColumn("embedding", F.expr("case when fine then transform(embedding, x -> cast(x + 0 as float)) end"))
    distinct = rows.where("fine").groupBy("label", "embedding").agg(F.count("*").alias("n"))
    distinct = written(distinct.withColumn("cls", F.monotonically_increasing_id()), "classes")
    member = rows.join(distinct.select("label", "embedding", "cls"), ["label", "embedding"], "left").select("vec_id", "cls")
    return distinct, member


def _signs(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return v @ planes >= 0


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def hashed(distinct: DataFrame, dims: int, bits: int, tables: int) -> DataFrame:
    """(id, label, n, buckets, signatures, sketch, vector) of each class: its bucket in every table, as
    bytes and as an array, the signs of SKETCH further hyperplanes, and the vector as bytes."""
    seed = SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng([seed, dims]).standard_normal((dims, tables * bits + SKETCH))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                plain = np.array(part.column(3).to_pylist(), "<f4").reshape(part.num_rows, dims)
                v = _unit(plain.astype(np.float64))
                signs = _signs(v, planes)
                signatures = (signs[:, : tables * bits].reshape(len(v), tables, bits) << np.arange(bits)).sum(2).astype("<i4")
                sketches = np.packbits(signs[:, tables * bits :], axis=1)
                columns = [part.column(k) for k in range(3)] + [pa.array([x.tobytes() for x in signatures], pa.binary()), pa.array(signatures.tolist(), pa.list_(pa.int32())), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array([x.tobytes() for x in plain], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "n", "buckets", "signatures", "sketch", "vector"])

    rows = distinct.select("cls", "label", "n", "embedding")
    return rows.mapInArrow(run, "id long, label long, n long, buckets binary, signatures array<int>, sketch binary, vector binary")


def possible_partners(limit: int):
    """Of a pair of blocks, (id, tag) of those with another id at most `limit` signs apart."""

    def links(tag: int, ids: np.ndarray, own: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(payload).view(np.uint64)
        some = np.zeros(len(ids), bool)
        for at in range(0, len(ids), 512):
            part = words[at : at + 512]
            apart = sum(np.bitwise_count(part[:, None, k] ^ words[None, :, k]).astype(np.int16) for k in range(words.shape[1]))
            near = apart <= limit
            near[np.arange(len(part)), at + np.arange(len(part))] = False
            some |= near.any(0)
        return ids[some], np.full(int(some.sum()), tag, np.int64)

    return links


def close_links(tables: int, least: float):
    """Of a pair of blocks, what the pairs of cosine >= `least` come to, each in the first table
    that it shares: edges (a, b) that span them, and (a, -m) for the m vectors that a links with."""

    def links(tag: int, ids: np.ndarray, own: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        payload = np.ascontiguousarray(payload)
        labels, sizes = (np.ascontiguousarray(payload[:, k : k + 8]).view(">i8")[:, 0] for k in (0, 8))
        buckets = np.ascontiguousarray(payload[:, 16 : 16 + 4 * tables]).view("<i4")
        v = _unit(np.ascontiguousarray(payload[:, 16 + 4 * tables :]).view("<f4").astype(np.float64))
        mixed, order = own.min() != own.max(), np.arange(len(ids))
        pairs, counts = np.zeros((len(ids), len(ids)), bool), np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), 512):
            rows = slice(at, at + 512)
            near = (v[rows] @ v.T >= least) & (order[rows, None] < order) & (labels[rows, None] == labels)
            # A bucket cut into blocks: pairs within one block come from that block's own pair.
            if mixed:
                near &= own[rows, None] != own
            for k in range(tag if near.any() else 0):
                near &= buckets[rows, None, k] != buckets[:, k]
            pairs[rows] = near
            counts[rows] += near @ sizes
            counts += sizes[rows] @ near
        some = np.flatnonzero(counts)
        if not len(some):
            return ids[:0], ids[:0]
        both = pairs[np.ix_(some, some)]
        both |= both.T
        a, b, left = [ids[some]], [-counts[some]], np.ones(len(some), bool)
        for root in range(len(some)):
            queue = [root] if left[root] else []
            left[root] = False
            while queue:
                x = queue.pop()
                found = np.flatnonzero(both[x] & left)
                left[found] = False
                queue += found.tolist()
                a.append(np.full(len(found), ids[some[x]]))
                b.append(ids[some[found]])
        return np.concatenate(a), np.concatenate(b)

    return links


def linked_classes(distinct: DataFrame, least: float) -> DataFrame:
    """(a, b) as close_links() says, over all classes of one label and dimension."""
    shape = distinct.groupBy("label").agg(F.count("*").alias("n"), F.collect_set(F.size("embedding")).alias("dims"))
    shape = shape.select("n", F.explode("dims").alias("dims")).groupBy("dims").agg(F.max("n").alias("n"))
    out = None
    apart = math.acos(min(1.0, least)) / math.pi
    limit = math.ceil(SKETCH * apart + DEVIATIONS * math.sqrt(SKETCH * apart * (1 - apart)))
    # One pass for each dimension that occurs: a table of embeddings has one.
    for row in shape.collect():
        bits, tables = tables_for(row["n"], least)
        rows = hashed(distinct.where(F.size("embedding") == row["dims"]), row["dims"], bits, tables)
        key = F.xxhash64("label", "signature").alias("key")
        sketched = rows.select("id", "label", "sketch", F.posexplode("signatures").alias("tag", "signature")).select("tag", key, "id", F.col("sketch").alias("payload"))
        active = compare(in_blocks(sketched), possible_partners(limit), SKETCH // 8).distinct()
        active = written(active.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.col("b").cast("int")).alias("tags")), "active")
        number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
        payload = F.concat(number("label"), number("n"), "buckets", "vector")
        own = rows.join(active, "id").select("id", "label", "signatures", payload.alias("payload"), F.explode("tags").alias("tag"))
        own = own.select("tag", F.xxhash64("label", F.col("signatures")[F.col("tag")]).alias("key"), "id", "payload")
        pairs = compare(in_blocks(own), close_links(tables, least), 16 + 4 * tables + 4 * row["dims"])
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else distinct.select(F.col("cls").alias("a"), F.col("cls").alias("b")).where("false")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors`.

    Equal vectors of a label are one class: they link with each other and share all other links.
    Null, zero and non-finite vectors, and rows without a label, link with nothing and are kept.
    Rows that repeat a vec_id each count as a vector. Only vectors of equal length are compared.
    """
    distinct, member = classes_of(vectors)
    member = written(member, "member")
    links = written(linked_classes(distinct, least), "links")
    sizes = distinct.select("cls", "n")
    other = links.where("b < 0").groupBy("a").agg(F.sum(-F.col("b")).alias("others"))
    found = connected_components(links.where("b >= 0"))
    classes = sizes.join(other.withColumnRenamed("a", "cls"), "cls", "left").join(found.withColumnRenamed("id", "cls"), "cls", "left")
    classes = classes.select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    least_id = member.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"))
    named = classes.join(least_id, "cls")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("cls", "n_links", "component_id")
    out = member.join(named, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings
  UNION
  SELECT l.b AS id, r.c FROM reach r JOIN links l ON l.a = r.id),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""
