"""Operator 7: passages that repeat across documents, found by doubling window lengths.

A window can repeat only if its half-length windows do. So the half-length windows come first, and
of those only the ones that winnowing selects: the smallest hash of each full window, which equal
windows select alike. Those that occur in two documents are extended to the full length, and the
full windows that repeat decide. Windows that very many documents share are counted before they are
shuffled, and dealt to many tasks. Longer windows hold only full windows that are decided already,
so the doubling ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import text_of, written

WINDOW = 50
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Words remembered with their hashes by each Python worker; beyond it the memory starts anew.
MEMO_WORDS = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A half window is hot if more rows hold it than HOT_LEAST and than a HOT_MOST-th of all selected
#: ones. So there are fewer than HOT_MOST hot ones, of 8 bytes each, however large the table is, and a
#: window that isn't hot is no larger than a task of a table that is dealt to HOT_MOST tasks. The
#: rows of a hot one are dealt to parts of about as many rows as the limit says.
HOT_LEAST = 1000
HOT_MOST = 1_000_000
#: A null doc_id comes after all others.
_LAST = (1 << 63) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(hashed: np.ndarray, length: int, base: int = _BASES[0]) -> np.ndarray:
    """A mixed polynomial hash of each window of `length` words."""
    n = len(hashed)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashed * _powers(base, n)[:n], dtype=np.uint64, out=sums[1:])
    x = (sums[length:] - sums[:-length]) * _powers(pow(base, -1, 1 << 64), n)[: n - length + 1]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def selected(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the first smallest hash of every `span` consecutive ones."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(np.arange(len(views)) + views.argmin(1))


def covered_starts(positions: np.ndarray, n_words: int, window: int, half: int) -> np.ndarray:
    """Starts of the windows that hold a half window at one of the positions."""
    marks = np.zeros(n_words + 2, np.int64)
    np.add.at(marks, np.maximum(positions - (window - half), 0), 1)
    np.add.at(marks, np.minimum(positions, n_words - window) + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: max(n_words - window + 1, 0)])


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))


def scanned(docs: DataFrame, window: int, half: int) -> DataFrame:
    """Of each document: its word count, the SHA-256 of its words, and its selected half windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, sha, hashes, starts = [], [], [], []
                for text in part.column(3).to_pylist():
                    words = text.encode().split()
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    own = np.zeros(0, np.uint64)
                    if len(words) >= window:
                        own = window_hashes(memo.of(words), half)
                    keep = selected(own, window - half + 1)
                    hashes.append(own[keep].view(np.int64))
                    starts.append(keep.astype(np.int32))
                columns = [part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(sha), pa.array(hashes, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ord", "th", "n_words", "sha", "hashes", "starts"])

    return _rows(docs).mapInArrow(run, "doc_id long, ord long, th long, n_words long, sha string, hashes array<long>, starts array<int>")


def full_windows(pending: DataFrame, window: int, half: int, hot: pa.Table) -> DataFrame:
    """(h1, h2, ord, th, start, parts) of each full window that holds a repeated half window.

    `hot` holds (h, parts) of fewer than HOT_MOST half windows. A window whose own smallest half
    window is one of them has its parts, and others 0: equal windows have the same.
    """
    crowded, dealt = (hot.column(c).to_numpy() for c in ("h", "parts"))
    order = np.argsort(crowded)
    #: A last entry for hashes larger than all.
    crowded, dealt = np.append(crowded[order], 0), np.append(dealt[order], 0).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for own, th, text, positions in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = text.encode().split()
                starts = covered_starts(np.array(positions, np.int64), len(words), window, half)
                hashed = memo.of(words)
                h1, h2 = (window_hashes(hashed, window, base)[starts] for base in _BASES)
                least = np.lib.stride_tricks.sliding_window_view(window_hashes(hashed, half), window - half + 1)[starts].min(1).view(np.int64)
                at = np.searchsorted(crowded[:-1], least)
                parts = np.where(crowded[at] == least, dealt[at], 0).astype(np.int32)
                columns = [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(np.full(len(starts), own, np.int64)), pa.array(np.full(len(starts), th, np.int64)), pa.array(starts.astype(np.int32)), pa.array(parts)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "ord", "th", "start", "parts"])

    return pending.select("ord", "th", "text", "positions").mapInArrow(run, "h1 long, h2 int, ord long, th long, start int, parts int")


def cut(texts: DataFrame, window: int) -> DataFrame:
    """ord, th, n_removed, kept_sha256 and kept (the words that stay, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                removed, sha, kept = [], [], []
                for text, starts in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words = text.encode().split()
                    marks = np.zeros(len(words) + 1, np.int64)
                    first = np.array(starts, np.int64)
                    np.add.at(marks, first, 1)
                    np.add.at(marks, first + window, -1)
                    stay = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
                    own = b" ".join([words[k] for k in stay])
                    removed.append(len(words) - len(stay))
                    sha.append(hashlib.sha256(own).hexdigest())
                    kept.append(own.decode())
                columns = [part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, ["ord", "th", "n_removed", "kept_sha256", "kept"])

    return texts.select("ord", "th", "text", "starts").mapInArrow(run, "ord long, th long, n_removed long, kept_sha256 string, kept string")


def removals(docs: DataFrame, window: int = WINDOW, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, changed).

    rows: doc_id, ord, th, n_words, sha and gone, for every row of `docs`; gone is true where the
    whole text is a copy of a document with a smaller doc_id, so that every word of it is covered.
    changed: ord, th, n_removed, kept_sha256, kept, one row for each other text that loses words.
    With `whole`, rows are instead `row` (of `docs`), ord, th and positions, which is null where the
    text holds no repeated half window, without the gone; so whole rows are shuffled once only.
    """
    half = (window + 1) // 2
    rows = written(scanned(docs, window, half), "scan")
    copies = rows.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").select("sha", "first")
    marked = rows.join(copies, "sha", "left").withColumn("gone", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)))
    # The hashes are shuffled by `sha` once, and read from this table by all that follows.
    single = written(marked.where("not gone and size(hashes) > 0").select("ord", "th", "hashes", "starts"), "single")
    halves = single.select("ord", "th", F.explode(F.arrays_zip("hashes", "starts")).alias("x")).select("ord", "th", F.col("x.hashes").alias("h"), F.col("x.starts").alias("start"))
    repeated = halves.groupBy("h").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n")).where("first < last")
    repeated = written(repeated.select("h", "n"), "repeated")
    total = single.agg(F.sum(F.size("hashes"))).first()[0] or 0
    limit = max(HOT_LEAST, -(-total // HOT_MOST))
    crowded = repeated.where(F.col("n") > limit).select("h", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    # The hot half windows, fewer than HOT_MOST, meet their rows without moving them; all others by a shuffle.
    few = halves.join(F.broadcast(crowded.select("h", F.lit(True).alias("hot"))), "h", "left")
    found = few.where("hot").select("ord", "th", "start").unionByName(few.where("hot is null").drop("hot").join(repeated.select("h"), "h").select("ord", "th", "start"))
    positions = found.groupBy("ord", "th").agg(F.collect_list("start").alias("positions"))
    if whole:
        keyed = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64(text_of(docs)).alias("th"))
        gone = marked.where("gone").select("ord", "th").distinct()
        rest = written(keyed.join(positions, ["ord", "th"], "left").join(gone, ["ord", "th"], "left_anti"), "rest")
        pending = rest.where("positions is not null").select("ord", "th", F.col("row.text").cast("string").alias("text"), "positions")
    else:
        texts = _rows(docs).select("ord", "th", "text")
        pending = written(texts.join(positions, ["ord", "th"]), "pending")
    windows = full_windows(pending, window, half, crowded.toArrow())
    first = F.min("ord").over(Window.partitionBy("h1", "h2").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = windows.where("parts = 0").withColumn("first", first).where("ord > first").select("ord", "th", "start")
    hot = windows.where("parts > 0")
    firsts = hot.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.max("parts").alias("parts")).where("first < last")
    # A row of each hot window's first document goes to each of the parts that its rows are dealt to.
    firsts = firsts.select("h1", "h2", F.col("first").alias("ord"), F.lit(None).cast("long").alias("th"), F.lit(-1).alias("start"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    dealt = hot.select("h1", "h2", "ord", "th", "start", F.pmod(F.xxhash64("ord", "th", "start"), F.col("parts")).cast("int").alias("salt")).unionByName(firsts)
    first = F.min("ord").over(Window.partitionBy("h1", "h2", "salt").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = covered.unionByName(dealt.withColumn("first", first).where("ord > first and start >= 0").select("ord", "th", "start"))
    starts = covered.groupBy("ord", "th").agg(F.collect_list("start").alias("starts"))
    changed = cut(pending.select("ord", "th", "text").join(starts, ["ord", "th"]).dropDuplicates(["ord", "th"]), window)
    return rest if whole else marked.select("doc_id", "ord", "th", "n_words", "sha", "gone"), changed


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without repeated windows; a text that keeps no word leaves its row out.

    A text that loses words becomes its other words, joined by one space; other texts stay as
    they are. n_chars, where there is such a column, follows the text. Null and empty texts stay as
    they are; a null doc_id counts as larger than all others, rows that repeat a doc_id remove
    nothing from each other, and an empty table gives no rows.
    """
    rows, changed = removals(docs, window, whole=True)
    out = rows.where("positions is not null").join(changed.select("ord", "th", "kept"), ["ord", "th"], "left").where("kept is null or kept <> ''")
    own = {"text": F.coalesce("kept", F.col("row.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(dict(docs.dtypes)["n_chars"]))
    same = rows.where("positions is null").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return same.union(out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]))


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of `docs`.

    Null and empty texts have no words. A null doc_id counts as larger than all others. Rows that
    repeat a doc_id remove nothing from each other, as neither doc_id is smaller.
    """
    rows, changed = removals(docs, window)
    out = rows.join(changed.drop("kept"), ["ord", "th"], "left")
    removed = F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("gone"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) t(i) WHERE len(ws) >= 50),
m AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT win.doc_id, win.i FROM win JOIN m USING (k) WHERE win.doc_id > m.d),
pos AS (SELECT DISTINCT doc_id, i + j AS p FROM cov, range(50) r(j)),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN pos ON pos.doc_id = words.doc_id AND pos.p = words.p WHERE pos.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
