"""Operator 12: lines that many documents share, counted in levelled sorted runs of line hashes.

Each batch of documents brings its own count of documents for each line hash. It is merged against
the runs before it: what a run already knows to be frequent is anti-joined away, and the rest is
added as a new run. When FANOUT runs of a level have come together they are compacted into one of
the next level. Runs are bucketed by hash and sorted within each bucket, so a batch is shuffled and
sorted once, and then merged with every run as it comes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import scratch_path, shuffle_partitions, text_of, written

#: A line that so many documents hold is dropped.
LEAST_DOCS = 10
#: Batches that a whole table is dealt to, and runs of a level that are compacted together.
BATCHES = 6
FANOUT = 3
#: Texts that a Python worker takes up at once.
SLICE = 512
#: A null doc_id, as a number.
_LAST = (1 << 63) - 1


def line_hash(line: bytes) -> bytes:
    """128 bits of the line's key, which is the line without white space around it and with A-Z in
    lower case; nothing for an empty key."""
    key = line.strip().lower()
    return xxhash.xxh3_128_digest(key) if key else b""


class LineRuns:
    """The runs so far: for each line hash, the documents that hold it, counted up to `least`."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = shuffle_partitions(spark)
        #: Of each level its runs, by name of table and path.
        self.levels: list[list[tuple[str, str]]] = []

    def _stored(self, counts: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "lines")
        rows = counts.repartition(self.buckets, "h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def unseen(self, counts: DataFrame, at_least: int = 1) -> DataFrame:
        """The rows whose hash no run holds in `at_least` documents."""
        for level in self.levels:
            for name, _ in level:
                counts = counts.join(self.spark.table(name).where(F.col("n") >= at_least).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch: `hashes` of its documents, arrays of (h1, h2) without repeats."""
        counts = lines.select(F.inline("hashes")).groupBy("h1", "h2").agg(F.least(F.count("*"), F.lit(self.least)).cast("int").alias("n"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._stored(self.unseen(counts, self.least)))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._stored(self._merged(level)))
                self._drop(level)
                self.levels[k] = []

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # By path, not as tables: Spark 4.1 takes a union of bucketed tables for bucketed itself, and sums wrongly.
        rows = self.spark.read.schema("h1 long, h2 long, n int").parquet(*[path for _, path in runs])
        return rows.groupBy("h1", "h2").agg(F.least(F.sum("n"), F.lit(self.least)).cast("int").alias("n"))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines in `least` documents or more, as a table of its own; ends the runs."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        out = written(self._merged(runs).where(F.col("n") >= self.least).select("h1", "h2"), "frequent")
        self._drop(runs)
        self.levels = []
        return out


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, ord, th, its number of lines, the SHA-256 of its text and the
    hashes of its lines, each once."""
    pair = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, sha, sizes, digests = [], [], [0], []
                for text in part.column(3).to_pylist():
                    raw = text.encode()
                    lines = raw.split(b"\n")
                    own = set(map(line_hash, lines)) - {b""}
                    n.append(len(lines))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    digests += own
                    sizes.append(len(digests))
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                flat = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], fields=list(pair))
                hashes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(sha), hashes], ["doc_id", "ord", "th", "n_lines", "sha", "hashes"])

    return _rows(docs).mapInArrow(run, "doc_id long, ord long, th long, n_lines long, sha string, hashes array<struct<h1:long,h2:long>>")


def cut_lines(texts: DataFrame) -> DataFrame:
    """(ord, th, n_dropped, kept_sha256, kept) of texts (ord, th, text, gone): the lines whose hash is in
    the array `gone` are left out, the others joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                dropped, sha, kept = [], [], []
                for text, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    own = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in gone}
                    lines = text.encode().split(b"\n")
                    stay = [line for line in lines if line_hash(line) not in own]
                    out = b"\n".join(stay)
                    dropped.append(len(lines) - len(stay))
                    sha.append(hashlib.sha256(out).hexdigest())
                    kept.append(out.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dropped, pa.int64()), pa.array(sha), pa.array(kept)], ["ord", "th", "n_dropped", "kept_sha256", "kept"])

    return texts.select("ord", "th", "text", "gone").mapInArrow(run, "ord long, th long, n_dropped long, kept_sha256 string, kept string")


def frequent_lines(scan: DataFrame, least: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2) of the lines that `least` rows or more of a scan, with column `batch`, hold."""
    runs = LineRuns(scan.sparkSession, least, fanout)
    for k in range(batches):
        runs.add(scan.where(F.col("batch") == k))
    return runs.frequent()


def dropped_lines(docs: DataFrame, least: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(scan, changed): each row of `docs` as scanned, and what is left of the texts that lose lines."""
    scan = scanned(docs).withColumn("batch", F.pmod(F.xxhash64("ord", "th"), F.lit(batches)).cast("int"))
    path = scratch_path(docs.sparkSession, "scan")
    scan.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    scan = docs.sparkSession.read.schema(scan.schema).parquet(path)
    frequent = frequent_lines(scan, least, batches, fanout)
    # A line that a third of all documents hold makes one large partition here: a skewed join, which is split.
    found = scan.select("ord", "th", F.inline("hashes")).join(frequent, ["h1", "h2"])
    gone = found.groupBy("ord", "th").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    texts = _rows(docs).select("ord", "th", "text").join(gone, ["ord", "th"]).dropDuplicates(["ord", "th"])
    return scan, cut_lines(texts)


def without_lines(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The rows of `docs` without the lines that `least` documents share; all rows and columns stay.

    Each row is a document. A text without such lines stays as it is, a null one null. n_chars, where
    there is such a column, follows the text.
    """
    _, changed = dropped_lines(docs, least)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64(text_of(docs)).alias("th"))
    out = keyed.join(changed.select("ord", "th", "kept"), ["ord", "th"], "left")
    own = {"text": F.coalesce("kept", F.col("row.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of `docs`.

    Each row is a document, also where rows repeat a doc_id or have none. A null or empty text is one
    empty line, and empty lines stay. An empty table gives no rows. Lines are told apart by 128 bits.
    """
    scan, changed = dropped_lines(docs, least)
    out = scan.select("doc_id", "ord", "th", "n_lines", "sha").join(changed.drop("kept"), ["ord", "th"], "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id
"""
