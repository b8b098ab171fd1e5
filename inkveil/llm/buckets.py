"""Pairs within buckets: rows that share a key are compared, in blocks of bounded size.

A bucket of more than `BLOCK_ROWS` rows is cut into blocks and dealt out as pairs of blocks, so
that no task ever holds more than two blocks of a bucket and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Where rows differ much in size, a block holds about so many bytes at most.
BLOCK_BYTES = 32 << 20


def hot_keys(rows: DataFrame, size: str | None = None) -> DataFrame:
    """(tag, key, blocks) of the buckets with more than BLOCK_ROWS rows, or more than BLOCK_BYTES
    by the column `size`."""
    own = F.col(size).cast("long") if size else F.lit(0).cast("long")
    sizes = rows.groupBy("tag", "key").agg(F.count("*").alias("n"), F.sum(own).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    return sizes.select("tag", "key", blocks.alias("blocks")).where("blocks > 1")


def in_blocks(rows: DataFrame, size: str | None = None) -> DataFrame:
    """Adds `own` (the row's block) and the pair of blocks (`low`, `high`) that it is dealt to."""
    hot = hot_keys(rows, size)
    dealt = rows.join(hot, ["tag", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("tag", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "payload")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the integer columns `by`, of batches sorted by them, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by], 1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for low, high in zip(starts, starts[1:]):
            if held and keys[low].tolist() != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = keys[low].tolist()
    if held:
        yield pa.Table.from_batches(held)


def compare(rows: DataFrame, links: Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """Calls `links(tag, ids, own, payload)` for each pair of blocks; returns its edges (a, b).

    rows: tag int, key long, low int, high int, own int, id long, payload binary of `width` bytes.
    Rows arrive sorted, so a task holds one pair of blocks at a time.
    """
    by = ["tag", "key", "low", "high"]
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(group: list[np.ndarray], payload: np.ndarray) -> tuple[list, list]:
            tag, key, low, high, own, ids = group
            n = len(ids)
            changed = np.flatnonzero((np.diff(key) != 0) | (np.diff(tag) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            starts = np.concatenate([[0], changed])
            sizes = np.diff(np.append(starts, n))
            out_a, out_b = [], []
            for s, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                a, b = links(int(tag[s]), ids[s : s + k], own[s : s + k], payload[s : s + k])
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
            return out_a, out_b

        def edges(out: tuple[list, list]) -> Iterator[pa.RecordBatch]:
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["a", "b"])

        held: list[np.ndarray] | None = None
        bytes_held = np.zeros((0, width), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            own = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, width)
            if held is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(held, columns)]
                own = np.concatenate([bytes_held, own])
            same = np.ones(len(own), bool)
            for k in range(4):
                same &= columns[k] == columns[k][-1]
            cut = len(own) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from edges(flush([x[:cut] for x in columns], own[:cut]))
            held, bytes_held = [x[cut:] for x in columns], own[cut:]
        if held is not None:
            yield from edges(flush(held, bytes_held))

    return dealt.mapInArrow(run, "a long, b long")
