"""Operator 1: token ids kept as canonical, length-limited Huffman code.

A store is a folder with two Parquet tables. `codebook` has the code length of every used id
(that alone fixes a canonical code). `blocks` has rows that can each be decoded alone: the ids of
some consecutive documents as one bit string, the documents' ids and token counts, and the bit
offset of every `STEP`-th token. Spark's committer writes both, so a lost executor leaves no
half-written file.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.bpe import byte_characters
from inkveil.llm.common import shuffle_partitions, text_of, written

#: Tokens between two bit-offset checkpoints, and the tokens after which a block is closed.
STEP = 128
BLOCK_TOKENS = 1 << 17
#: No code is longer, so that one table of 2**MAX_BITS entries decodes every id; only where more
#: ids than that are used are codes as many bits longer as it takes to tell them apart.
MAX_BITS = 16
#: Words remembered with their ids by each Python worker; beyond it half of them go.
MEMO_WORDS = 400_000

_BLOCKS = (
    "part int, block int, first_token long, n_tokens long, doc_ids array<long>, counts array<int>, "
    "offsets array<long>, bits binary"
)


#: Letters and then ASCII marks other than the apostrophe: two pre-tokens, whatever they are.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_BELOW_0300 = bytes(range(0xCC))


def split_words(raw: bytes) -> list[bytes]:
    """A text's UTF-8 bytes cut at ASCII white space, over which no pre-token goes on.

    Where no character can combine with another (all are below U+0300) and no special token can
    arise, lower case leaves the ids as they are, and leaves fewer words to tell apart.
    """
    if b"<|" not in raw and not raw.translate(None, _BELOW_0300):
        raw = raw.lower()
    return raw.split()


class WordMemo(dict):
    """Ids of words, as bytes, from the tokenizers library; a new word is encoded once.

    Words of letters below U+0300, in lower case, are one pre-token that the normalizer leaves as
    it is, so their bytes go to the library's model at once; so do a word and the marks after it,
    each by itself. Full memory becomes the older half, from which words in use come back, so that
    memory stays bounded.
    """

    def __init__(self, tokenizer_path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.code = "H" if dtype == "<u2" else "I"
        self.older: dict[bytes, bytes] = {}
        self.shown = {b: c for c, b in byte_characters().items()}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self._encode(word.decode().lower(), word)
        self[word] = value
        return value

    def _model(self, token: str) -> bytes:
        if not token.isascii():
            token = token.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(token)]).tobytes()

    def _encode(self, text: str, word: bytes) -> bytes:
        if text.isascii() or max(text) < "\u0300":
            if text.isalpha():
                return self._model(text)
            if found := _MARKED.fullmatch(text):
                letters, marks = found.groups()
                if marks not in self.marks:
                    if len(self.marks) > MEMO_WORDS:
                        self.marks.clear()
                    self.marks[marks] = self._model(marks)
                return self[letters.encode()] + self.marks[marks]
        return array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def bounded(self) -> None:
        if len(self) > MEMO_WORDS:
            self.older = dict(self)
            self.clear()


_MEMOS: dict[tuple[str, str], WordMemo] = {}


def worker_memo(tokenizer_path: str, dtype: str) -> WordMemo:
    """The memo of this Python worker, which its later tasks go on with."""
    key = tokenizer_path, dtype
    if key not in _MEMOS:
        _MEMOS[key] = WordMemo(tokenizer_path, dtype)
    return _MEMOS[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int) -> DataFrame:
    """(doc_id, ids binary) of every whole text; null texts count as empty; `end_id` closes each.

    `ids` holds little-endian unsigned integers of 2 bytes where the vocabulary allows it, else 4.
    """
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(tokenizer_path, dtype)
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                memo.bounded()
                ids = [b"".join(map(memo.__getitem__, split_words(t))) + end for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def token_counts(tokens: DataFrame, vocab_size: int) -> np.ndarray:
    """How often each id occurs in all documents. At most `vocab_size` rows leave each task."""
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 512).to_pylist()), dtype), minlength=vocab_size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocab_size, np.int64)
    for row in counted.collect():
        out[row["id"]] = row["n"]
    return out


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur.

    Where more than 2**limit ids occur, the limit is the least that they fit in.
    """
    used = np.flatnonzero(counts)
    limit = max(limit, (len(used) - 1).bit_length())
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        packages = level[0:even:2] + level[1:even:2]
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    own = lengths[order].astype(np.uint64)
    top = int(own.max())
    room = np.uint64(1) << (np.uint64(top) - own)
    codes[order] = (np.cumsum(room) - room) >> (np.uint64(top) - own)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window of `bits` bits the id that it starts with, and that id's code length."""
    bits = max(1, int(lengths.max(initial=0)))
    codes = canonical_codes(lengths)
    order = np.lexsort((codes, lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbols = np.repeat(order, spans)
    pad = (1 << bits) - len(symbols)
    return np.pad(symbols, (0, pad)).astype(np.uint32), np.pad(np.repeat(lengths[order], spans), (0, pad)).astype(np.int64), bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids as one bit string, most significant bit first, and the offset of each STEP-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    own = lengths[ids].astype(np.int64)
    ends = np.cumsum(own)
    starts = ends - own
    word, shift = starts >> 6, 64 - (starts & 63) - own
    code = codes[ids]
    whole = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(whole, first)
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::STEP].copy()


def unpack(bits: bytes, offsets: np.ndarray, n_tokens: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block. All checkpoints advance together, one table look-up per id."""
    symbols, lengths, width = table
    if not n_tokens:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((STEP, len(offsets)), np.uint32)
    at, last, mask = offsets.astype(np.int64), (len(window) - 1) << 3, np.uint32((1 << width) - 1)
    for k in range(STEP):
        own = window[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32) & mask
        out[k] = symbols[own]
        at = np.minimum(at + lengths[own], last)
    return out.T.reshape(-1)[:n_tokens]


def write_store(tokens: DataFrame, path: str, vocab_size: int) -> None:
    """Writes (doc_id, ids) in ascending doc_id order; null ids first, equal ids by their tokens."""
    spark = tokens.sparkSession
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"
    lengths = code_lengths(token_counts(tokens, vocab_size))
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, own = canonical_codes(lengths), lengths
        docs, counts, held, n, first, block, part = [], [], [], 0, 0, 0, 0

        def close() -> pa.RecordBatch:
            bits, offsets = pack(np.concatenate(held), codes, own)
            row = [[part], [block], [first], [n], [docs], [counts], [offsets.tolist()], [bits]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "first_token", "n_tokens", "doc_ids", "counts", "offsets", "bits"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, ids, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                part = number
                held.append(np.frombuffer(ids.as_buffer(), dtype))
                docs.append(doc_id)
                counts.append(len(held[-1]))
                n += counts[-1]
                if n >= BLOCK_TOKENS:
                    yield close()
                    docs, counts, held, first, block, n = [], [], [], first + n, block + 1, 0
        if docs:
            yield close()

    ordered = tokens.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(blocks, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _decoded(spark: SparkSession, path: str, vocab_size: int, shown: Callable[[np.ndarray, np.ndarray], list[pa.Array]], columns: dict[str, str]) -> DataFrame:
    """doc_id, start and `columns` of every document in the store: what `shown` makes of the ids of consecutive
    documents and of where each of them ends. Blocks are decoded independently of each other."""
    lengths = np.zeros(vocab_size, np.uint8)
    for row in spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect():
        lengths[row["id"]] = row["bits"]
    names = ["doc_id", "start", *columns]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for base, row in zip(batch.column(0).to_pylist(), batch.select(["first_token", "n_tokens", "doc_ids", "counts", "offsets", "bits"]).to_pylist()):
                ids = unpack(row["bits"], np.array(row["offsets"], np.int64), row["n_tokens"], table).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = base + row["first_token"] + ends - counts
                for at in range(0, len(counts), 512):
                    cut = slice(at, at + 512)
                    first = ends[at] - counts[at]
                    own = shown(ids[first : ends[cut][-1]], ends[cut] - first)
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][cut], pa.int64()), pa.array(starts[cut]), *own], names)

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    #: One row per written file: no more than the partitions of the write.
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = blocks.join(F.broadcast(bases), "part").select("base", "first_token", "n_tokens", "doc_ids", "counts", "offsets", "bits")
    return rows.mapInArrow(decode, ", ".join(f"{k} {v}" for k, v in {"doc_id": "long", "start": "long", **columns}.items()))


def read_store(spark: SparkSession, path: str, vocab_size: int) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), ids (little-endian
    unsigned 32-bit integers)."""

    def shown(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        return [pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())]

    return _decoded(spark, path, vocab_size, shown, {"ids": "binary"})


def store_digest(spark: SparkSession, path: str, vocab_size: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the store, made where its ids are decoded."""

    def shown(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.diff(ends, prepend=0)), pa.array([zlib.crc32(x) for x in np.split(ids, ends[:-1])], pa.int64())]

    return _decoded(spark, path, vocab_size, shown, {"n_tokens": "long", "ids_crc32": "long"})


def store_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocab_size: int) -> None:
    """Tokenizes once into a scratch table, counts all ids, and writes the store."""
    write_store(written(encode_documents(docs, tokenizer_path, end_id, vocab_size), "ids"), path, vocab_size)
