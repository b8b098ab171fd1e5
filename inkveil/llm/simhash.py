"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints of m bit groups that differ in at most `tau` bits differ in at most t_i bits of
some group i whenever the sum of (t_i + 1) is tau + 1. The groups hold correlated bits, and the
t_i are allocated by dynamic programming on the numbers of candidates that they would cause.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.buckets import compare, hot_keys, in_blocks, whole_groups
from inkveil.llm.common import text_of, written
from inkveil.llm.components import connected_components

SEED = 42
_LAST = (1 << 63) - 1
#: Fingerprints of more than 64 bits take further 64-bit lanes from further seeds.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, words: int, lanes: int = 1) -> bytes:
    """The fingerprint as little-endian bytes, 8 for each lane.

    Words are what ASCII white space separates, A-Z in lower case. Fewer words than a shingle
    takes make one shingle; no words make the fingerprint zero.
    """
    w = text.encode().lower().split()
    if not w:
        return bytes(8 * lanes)
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*(w[k:] for k in range(words)))))
    out = []
    for lane in range(lanes):
        hashed = np.array([xxhash.xxh64_intdigest(s, SEED + lane) for s in shingles], np.uint64)
        cells = (hashed.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).reshape(-1)
        counts = (np.bincount(cells, minlength=2048).reshape(8, 256) @ _BITS).reshape(-1)
        out.append(np.packbits(2 * counts > len(shingles), bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """(doc_id, th, fp binary, word long) of every whole text; null texts count as empty.

    `th` is a hash of the text, `word` the first lane's 64 bits as a signed number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [fingerprint(t, words, lanes) for t in part.column(2).to_pylist()]
                first = np.frombuffer(b"".join(x[:8] for x in own), "<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary()), pa.array(first)], ["doc_id", "th", "fp", "word"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("th"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp binary, word long")


def bit_moments(distinct: DataFrame, n_bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, how often each bit is set, and each pair of bits, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, single, both = 0, np.zeros(n_bits), np.zeros((n_bits, n_bits))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                raw = np.frombuffer(b"".join(batch.column(0).slice(at, 4096).to_pylist()), np.uint8).reshape(-1, n_bits // 8)
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
                n, single, both = n + len(bits), single + bits.sum(0), both + bits.T @ bits
        flat = np.concatenate([[n], single, both.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "x"])

    rows = distinct.select("fp").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + n_bits + n_bits * n_bits)
    for row in rows:
        flat[row["at"]] = row["x"]
    return int(flat[0]), flat[1 : 1 + n_bits], flat[1 + n_bits :].reshape(n_bits, n_bits)


def correlated_groups(n: int, single: np.ndarray, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits dealt into groups of nearly equal size; each takes the bits most correlated with it."""
    p = single / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(len(p))), []
    for k in range(groups):
        size = len(left) // (groups - k)
        own = [max(left, key=lambda b: (corr[b, sorted(left)].max(), -b))]
        left.remove(own[0])
        while len(own) < size:
            b = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def same_group_pairs(distinct: DataFrame, groups: list[list[int]]) -> list[int]:
    """For each group the ordered pairs of fingerprints that agree on all its bits."""
    keys = F.array(*[F.struct(F.lit(k).alias("g"), F.col("word").bitwiseAND(F.lit(_signed(_mask(bits)))).alias("v")) for k, bits in enumerate(groups)])
    sizes = distinct.select(F.inline(keys)).groupBy("g", "v").agg(F.count("*").alias("n"))
    rows = sizes.groupBy("g").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
    found = {row["g"]: row["pairs"] for row in rows}
    return [found.get(k, 0) for k in range(len(groups))]


def allocate(same: list[int], groups: list[list[int]], n: int, single: np.ndarray, tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 whose sum of (t_i + 1) is tau + 1, at the least estimated cost.

    The cost of a group at t is its keys for each fingerprint and its candidates: pairs that agree
    on the group, times the odds that up to t of its bits differ.
    """
    p = single / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    cost = np.full((len(groups), tau + 2), np.inf)
    for g, bits in enumerate(groups):
        poly = np.zeros(tau + 2)
        poly[0] = 1
        for b in bits:
            poly[1:] += poly[:-1] * odds[b]
        cost[g, 0] = 0
        keys = 1.0
        for t in range(tau + 1):
            keys = keys if t == 0 else keys * (len(bits) - t + 1) / t
            cost[g, t + 1] = n * keys * 20 + same[g] * poly[: t + 1].sum()
    best, choice = np.full((len(groups) + 1, tau + 2), np.inf), np.zeros((len(groups) + 1, tau + 2), int)
    best[0, 0] = 0
    for g in range(len(groups)):
        for used in range(tau + 2):
            for own in range(tau + 2 - used):
                total = best[g, used] + cost[g, own]
                if total < best[g + 1, used + own]:
                    best[g + 1, used + own], choice[g + 1, used + own] = total, own
    out, used = [], tau + 1
    for g in range(len(groups), 0, -1):
        out.append(int(choice[g, used]) - 1)
        used -= choice[g, used]
    return float(best[len(groups), tau + 1]), out[::-1]


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Masks such that fingerprints within t_i bits on a group i agree under one of them."""
    out = []
    for bits, t in zip(groups, thresholds):
        if t >= 0:
            for gone in itertools.combinations(bits, t):
                out.append(_mask([b for b in bits if b not in gone]))
    return out


def spanning_links(limit: int):
    """Within a pair of blocks, a spanning forest of the links of at most `limit` bits."""

    def links(tag: int, ids: np.ndarray, own: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(payload).view(np.uint64)
        if len(ids) <= 256:
            far = np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(2, dtype=np.int64)
            near = far <= limit
            if near.sum() == len(ids):
                return ids[:0], ids[:0]
        left, a, b = np.arange(len(ids)), [], []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                found = np.bitwise_count(words[left] ^ words[x]).sum(1, dtype=np.int64) <= limit
                if found.any():
                    hit = left[found]
                    a.append(np.full(len(hit), ids[x]))
                    b.append(ids[hit])
                    queue.extend(hit.tolist())
                    left = left[~found]
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    return links


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(k).alias("tag"), F.col("id").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    return rows.select("id", "payload", F.inline(keys))


def refined(rows: DataFrame, masks: list[int], tau: int) -> tuple[DataFrame, list[int]]:
    """Rows of buckets above BLOCK_ROWS are dealt anew: pairs there agree under the bucket's mask,
    so of the other bits, cut into tau + 1 parts, they agree on one part whole."""
    finer, start = list(masks), {}
    for k, m in enumerate(masks):
        rest = [b for b in range(64) if not m >> b & 1]
        start[k] = len(finer)
        finer += [m | _mask(rest[c :: tau + 1]) for c in range(tau + 1)]
    hot = hot_keys(rows).select("tag", "key", F.lit(True).alias("hot"))
    marked = rows.join(hot, ["tag", "key"], "left")
    options = F.array(*[F.array(*[F.struct(F.lit(start[k] + c).alias("tag"), F.lit(_signed(finer[start[k] + c])).alias("mask")) for c in range(tau + 1)]) for k in range(len(masks))])
    plain = F.array(F.struct(F.col("tag").alias("tag"), F.lit(0).cast("long").alias("mask")))
    dealt = marked.withColumn("to", F.explode(F.when(F.col("hot"), options[F.col("tag")]).otherwise(plain)))
    key = F.when(F.col("hot"), F.col("id").bitwiseAND(F.col("to.mask"))).otherwise(F.col("key"))
    return dealt.select(F.col("to.tag").alias("tag"), key.alias("key"), "id", "payload"), finer


def link_within(distinct: DataFrame, tau: int) -> DataFrame:
    """Edges (a, b) between 64-bit fingerprints (column `word`, with its 8 bytes in `fp`) that
    connect the same fingerprints as all pairs of at most `tau` differing bits do."""
    n, single, both = bit_moments(distinct, 64)
    best: tuple[float, list[int]] | None = None
    for m in range(2, tau + 3):
        groups = correlated_groups(n, single, both, m)
        cost, thresholds = allocate(same_group_pairs(distinct, groups), groups, n, single, tau)
        if best is None or cost < best[0]:
            best = cost, probe_masks(groups, thresholds)
    rows = _keyed(distinct.select(F.col("word").alias("id"), F.col("fp").alias("payload")), best[1])
    rows, _ = refined(rows, best[1], tau)
    return compare(in_blocks(rows), spanning_links(tau), 8)


def near_duplicates(docs: DataFrame, words: int = 3, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`.

    component_id is the smallest doc_id that links of at most `tau` bits reach, itself included.
    Rows with equal texts, repeated doc_ids included, share a fingerprint and so a component. Null
    and empty texts have the fingerprint zero. A null doc_id takes part, and never names a
    component unless all doc_ids of that component are null.
    """
    rows = written(fingerprints(docs, words), "fps")
    distinct = written(rows.groupBy("word", "fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(link_within(distinct, tau))
    named = distinct.select("word", "least").join(found.withColumnRenamed("id", "word"), "word", "left")
    named = named.withColumn("component", F.coalesce("component", "word"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(names, "component").select("word", "component_id")
    hexed = F.lower(F.lpad(F.hex("word"), 16, "0"))
    return rows.join(names, "word").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Values of a sketch that make one key: texts agree on a key at odds of their similarity ** BAND.
BAND = 5
#: Odds, at most, that two texts just similar enough share no key.
MISS = 1e-8
#: Pairs whose estimate is further below the similarity than so many standard deviations are let go.
DEVIATIONS = 5.5
#: Pairs of texts that a cell of the exact comparison should hold on average.
CELL_PAIRS = 2048


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes, of the words that fingerprint() takes."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = {b" ".join(w)} if len(w) <= words else set(map(b" ".join, zip(*(w[k:] for k in range(words)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def bands_for(similarity: float) -> int:
    """Keys that a sketch needs so that texts of that similarity are missed at odds of MISS."""
    if similarity >= 1:
        return 1
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(similarity**BAND))))


def sketch(own: np.ndarray, bands: int) -> np.ndarray:
    """The least value of the shingles under each of bands * BAND hash functions."""
    rng = np.random.default_rng(SEED)
    first, second = (rng.integers(0, 1 << 31, (bands * BAND, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    least = np.full(bands * BAND, 0xFFFFFFFF, np.uint32)
    low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(own), 1024):
        least = np.minimum(least, (low[at : at + 1024] * first + high[at : at + 1024] * second).min(1))
    return least


def sketches(docs: DataFrame, words: int, bands: int, print_words: int) -> DataFrame:
    """(doc_id, th, fp, keys, sketch, print, word) of every text; null texts count as empty.

    `fp` is a 128-bit hash of the set of shingles, `sketch` a byte of each of the sketch's values; `print` and
    `word` are the fingerprint of shingles of `print_words` words, as bytes and as a signed number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                sets = [shingle_set(t, words) for t in texts]
                least = [sketch(x, bands) for x in sets]
                prints = [fingerprint(t, print_words) for t in texts]
                keys = [[xxhash.xxh64_intdigest(x[k * BAND : k * BAND + BAND].tobytes(), k) - (1 << 63) for k in range(bands)] if len(own) else [] for x, own in zip(least, sets)]
                columns = [part.column(0), part.column(1), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                columns += [pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()), pa.array(prints, pa.binary()), pa.array(np.frombuffer(b"".join(prints), "<i8"))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "fp", "keys", "sketch", "print", "word"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("th"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp binary, keys array<long>, sketch binary, print binary, word long")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the texts whose hash is one of `ids`. Each text is shuffled once, however
    many rows repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.xxhash64(text_of(docs)).alias("id"), text_of(docs).alias("text")).groupBy("id").agg(F.first("text").alias("text"))
    return texts.join(ids.select("id").distinct(), "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def similar_enough(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles) have a Jaccard similarity of at least `similarity`.

    Pairs are dealt to a square of cells by their ends, so that a cell gets each set just once
    however many pairs of it there are.
    """
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    side = max(16, math.ceil(math.sqrt(pairs.count() / CELL_PAIRS)))
    dealt = pairs.withColumn("x", F.pmod(F.xxhash64("a"), F.lit(side)).cast("int")).withColumn("y", F.pmod(F.xxhash64("b"), F.lit(side)).cast("int"))
    ends = dealt.select("x", "y", F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = ends.join(sets, "id").select(F.col("x").alias("to_x"), F.col("y").alias("to_y"), "id", "shingles")

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        found = {k: np.frombuffer(v, np.uint64) for k, v in zip(held.column("id").to_pylist(), held.column("shingles").to_pylist())}
        out = []
        for a, b in zip(own.column("a").to_pylist(), own.column("b").to_pylist()):
            if similar(found[a], found[b], similarity):
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.groupBy("x", "y").cogroup(needed.groupBy("to_x", "to_y")).applyInArrow(run, "a long, b long")


def open_pairs(key: int, own: np.ndarray, component: np.ndarray, keys: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Within a pair of blocks of the bucket `key`: a row, and the rows that it is still to be
    compared with. They are of another component, share `least` bytes of sketches and have `key`
    as the first of the keys they share, so that a pair is compared in one bucket only.
    """
    values, sizes = np.unique(component, return_counts=True)
    largest = component == values[sizes.argmax()]
    # Rows of the largest component come last: every row is held against those after it.
    order = np.argsort(largest, kind="stable")
    component, own, two = component[order], own[order], own.min() != own.max()
    before = np.ascontiguousarray(keys[order, : np.argmax(keys[0] == key)].T)
    sketch = np.ascontiguousarray(sketch[order].T)
    number = np.uint8 if len(sketch) < 256 else np.uint32
    for k in range(len(order) - int(largest.sum())):
        fits = component[k + 1 :] != component[k]
        if two:
            fits &= own[k + 1 :] != own[k]
        fits &= ~(before[:, k + 1 :] == before[:, k : k + 1]).any(0)
        if fits.any():
            alike = (sketch[:, k + 1 :] == sketch[:, k : k + 1]).view(np.uint8).sum(0, dtype=number)
            near = order[k + 1 :][fits & (alike >= least)]
            if len(near):
                yield int(order[k]), near


def open_ids(bands: int, least: int):
    """Edges (id, bucket) of the ids that have anything left to be compared with in a bucket.

    The payload is component, bucket, keys and sketch.
    """

    def links(tag: int, ids: np.ndarray, own: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.ascontiguousarray(payload[:, : 16 + 8 * bands]).view(">i8")
        found, key = np.zeros(len(ids), bool), int(numbers[0, 1])
        for k, near in open_pairs(key, own, numbers[:, 0], numbers[:, 2:], payload[:, 16 + 8 * bands :], least):
            found[k] = found[near] = True
        return ids[found], np.full(int(found.sum()), key)

    return links


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared) >= similarity


def similar_in_buckets(rows: DataFrame, bands: int, similarity: float, least: int) -> DataFrame:
    """Edges (a, b) that connect, with the components that rows have, what open pairs of at least
    that similarity connect.

    rows: tag, key, id, payload: component, keys, sketch, shingles. A pair of blocks gives fewer
    edges than it has rows, and what its edges connect already isn't compared again.
    """
    by = ["tag", "key", "low", "high"]
    dealt = in_blocks(rows.withColumn("size", F.length("payload.shingles")), "size")
    dealt = dealt.select(*by, "own", "id", "payload.*").repartition(*by).sortWithinPartitions(*by, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, by):
            ids, own, component = (group.column(c).to_numpy() for c in ("id", "own", "component"))
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, bands)
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets])
            # Shingles get numbers within the group, so that a row's can be marked and looked up.
            shingles, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            numbered = np.split(numbers.astype(np.int32), np.cumsum(size)[:-1])
            marked, joined, a, b = np.zeros(len(shingles), np.uint8), component.copy(), [], []
            for k, near in open_pairs(group.column("key")[0].as_py(), own, component, keys, sketch, least):
                near = near[joined[near] != joined[k]]
                near = near[np.minimum(size[near], size[k]) >= similarity * np.maximum(size[near], size[k]) - 1]
                if not len(near):
                    continue
                marked[numbered[k]] = 1
                starts = np.cumsum(size[near]) - size[near]
                shared = np.add.reduceat(marked[np.concatenate([numbered[j] for j in near.tolist()])], starts, dtype=np.int64)
                marked[numbered[k]] = 0
                for j in near[shared / (size[near] + size[k] - shared) >= similarity].tolist():
                    if joined[j] != joined[k]:
                        joined[joined == joined[j]] = joined[k]
                        a.append(ids[k])
                        b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar_links(distinct: DataFrame, docs: DataFrame, words: int, similarity: float, bands: int) -> DataFrame:
    """Edges (a, b) that connect the same ids as all pairs of at least that similarity do.

    distinct: id (the hash of a text in `docs`), keys, sketch. Texts that share a key are
    candidates. First each is held against one text, of those that share most buckets with others,
    so that a large group is linked by few pairs; then all pairs of a bucket that are not connected
    yet are compared, first by sketches, then, where those don't tell, by the sets. Every edge is
    decided by the exact similarity. Buckets give ids and spanning edges, never all pairs.
    """
    keyed = distinct.select("id", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(sizes, "key"), "members")
    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    tops = members.join(fame, "id").groupBy("key").agg(F.max(F.struct("fame", "id")).alias("top"))
    stars = members.join(tops, "key").groupBy("id").agg(F.max("top").alias("top")).select(F.col("id").alias("a"), F.col("top.id").alias("b")).where("a <> b")
    sets = written(shingle_sets(docs, members, words), "sets")
    links = written(similar_enough(stars, sets, similarity), "links")
    found = connected_components(links)
    labelled = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    known = written(distinct.select("id", "keys", "sketch").join(members.select("id").distinct(), "id", "left_semi"), "known")
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    packed = F.concat(number("component"), number("key"), F.concat(*[number(F.col("keys")[k]) for k in range(bands)]), "sketch")
    values = bands * BAND
    least = math.floor(values * (similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / values)))
    dealt = in_blocks(labelled.join(mixed, "key").select(F.lit(0).alias("tag"), "key", "id", F.col("component").alias("payload")))
    dealt = dealt.withColumnRenamed("payload", "component").join(known, "id").select("tag", "key", "low", "high", "own", "id", packed.alias("payload"))
    left = compare(dealt, open_ids(bands, least), 16 + 8 * bands + values)
    left = written(left.select(F.col("a").alias("id"), F.col("b").alias("key")).distinct(), "open")
    held = known.join(left.select("id").distinct(), "id", "left_semi").join(sets, "id").join(found, "id", "left")
    payload = F.struct(F.coalesce("component", "id").alias("component"), "keys", "sketch", "shingles")
    rows = left.join(held.select("id", payload.alias("payload")), "id").select(F.lit(0).alias("tag"), "key", "id", "payload")
    return links.unionByName(similar_in_buckets(rows, bands, similarity, least))


def fingerprint_links(rows: DataFrame, distinct: DataFrame, tau: int) -> DataFrame:
    """Edges (a, b) that connect the same ids as all pairs of fingerprints of at most `tau` differing bits do.

    rows: fp, print, word of every text; distinct: fp and id of every set of shingles, of which texts of
    several fingerprints may have the same.
    """
    named = written(rows.select("fp", "print", "word").distinct().join(distinct.select("fp", "id"), "fp").select("id", "print", "word"), "prints")
    prints = written(named.groupBy("word", F.col("print").alias("fp")).agg(F.min("id").alias("least")), "words")
    same = named.join(prints, "word").select(F.col("id").alias("a"), F.col("least").alias("b")).where("a <> b")
    ends = [prints.select(F.col("word").alias(c), F.col("least").alias(f"to_{c}")) for c in "ab"]
    near = link_within(prints, tau).join(ends[0], "a").join(ends[1], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    return same.unionByName(near)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, tau: int | None = None, print_words: int = 3) -> DataFrame:
    """The rows of `docs`, one of each group of near-duplicates: the smallest doc_id's.

    Two texts are near-duplicates if the Jaccard similarity of their distinct shingles is
    `similarity` or more, or, where `tau` is given, if near_duplicates() links them: their fingerprints of
    shingles of `print_words` words differ in at most `tau` bits. Groups are what such pairs connect. Equal
    texts always are; so are all texts without words. A null doc_id comes last; rows that repeat a doc_id come in the order
    of their texts' hashes.
    """
    bands = bands_for(similarity)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "keys", "sketch")
    rows = written(sketches(docs, words, bands, print_words), "sketches")
    distinct = rows.groupBy("fp").agg(F.min(order).alias("first")).select("fp", "first", F.col("first.th").alias("id"), F.col("first.keys").alias("keys"), F.col("first.sketch").alias("sketch"))
    distinct = written(distinct, "distinct")
    links = similar_links(distinct, docs, words, similarity, bands)
    found = connected_components(links if tau is None else links.unionByName(fingerprint_links(rows, distinct, tau)))
    named = distinct.select("id", F.struct("first.last", "first.doc_id", "first.th").alias("first")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("stay_id"), F.col("first.th").alias("stay_th"))
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("_row_id"), F.xxhash64(text_of(docs)).alias("_row_th"))
    stay = stay.select(F.coalesce("stay_id", F.lit(_LAST)).alias("_row_id"), F.col("stay_th").alias("_row_th"))
    once = F.row_number().over(Window.partitionBy("_row_id", "_row_th").orderBy(F.lit(1)))
    kept = keyed.join(stay, ["_row_id", "_row_th"], "left_semi").withColumn("_row_no", once).where("_row_no = 1")
    return kept.select("_row.*")
