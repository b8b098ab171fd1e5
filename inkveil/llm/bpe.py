"""Operator 8: byte-level BPE as a streaming transducer of bounded lookahead, and its decoder.

Merging in order of rank lets text on the right change a token only through a chain of merges of
falling rank, each of which takes the left end of what the one before it would have taken. The
longest such chain of the merge list, in bytes, is a lookahead that suffices: a token that ends so
far before the end of what has been read is final. So the transducer merges a window, emits its
final tokens, and goes on from there; its memory doesn't grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkveil.llm.common import text_of

#: Characters that a text is fed in, bytes of a window beyond the lookahead, and words remembered.
FEED = 1 << 16
WINDOW = 4096
MEMO_WORDS = 250_000
_WS = r"\t-\r \x85\xa0  -     　"
#: The pre-tokenizer's pattern (fixed value), with its white space spelt out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: White space in a row, or other than blanks and line ends.
_ODD = ["  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
_RUNS = {"letters": r"\p{L}*", "numbers": r"\p{N}*", "other": rf"[^{_WS}\p{{L}}\p{{N}}]*", "space": rf"[{_WS}]*"}


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it prints, else 256 and on in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in prints}
    for k, b in enumerate(x for x in range(256) if x not in set(prints)):
        out[chr(256 + k)] = b
    return out


def _read(path: str) -> tuple[dict, dict[str, int], dict[str, int]]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return data, byte_characters(), data["model"]["vocab"]


def _specials(data: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in data["added_tokens"]}


def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    data, by_char, vocab = _read(path)
    specials = _specials(data)
    out = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
    for token, k in vocab.items():
        out[k] = bytes(by_char[c] for c in token) if all(c in by_char for c in token) else token.encode()
    for token, k in specials.items():
        out[k] = token.encode()
    return out


class Vocabulary:
    """Bytes of every id, the ids of single bytes, ranked merges, special texts, the lookahead."""

    def __init__(self, path: str):
        data, by_char, vocab = _read(path)
        self.specials, self.bytes = _specials(data), token_bytes(path)
        self.byte_ids = [0] * 256
        for char, b in by_char.items():
            self.byte_ids[b] = vocab[char]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made, self.none = [made for _, made in self.merges.values()], len(self.merges)
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes of the longest chain of merges that can carry a change leftwards.

        Whether (c, d) is applied depends on what stands to the right of c only through earlier
        merges whose left part is d or a part that ends d; each of those depends likewise on its
        own right part. Merges come in rank order, so each chain is known when it is needed.
        """
        ends: dict[int, list[int]] = {}
        reach: dict[int, int] = {}
        longest = 0
        for (left, right), (_, made) in self.merges.items():
            own = ends.get(right, [right])
            chain = len(self.bytes[right]) + max((reach.get(x, 0) for x in own), default=0)
            ends[made] = [made, *own]
            reach[left] = max(reach.get(left, 0), chain)
            longest = max(longest, len(self.bytes[left]) + chain)
        return longest

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of a short run of bytes: the merge of least rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in raw]
        ranks, none = self.ranks, self.none
        found = [ranks.get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            k = found.index(best)
            ids[k : k + 2] = (self.made[best],)
            del found[k]
            if k < len(found):
                found[k] = ranks.get((ids[k], ids[k + 1]), none)
            if k:
                found[k - 1] = ranks.get((ids[k - 1], ids[k]), none)
        return ids

    def merge_window(self, raw: bytes) -> list[int]:
        """The same for a window of many bytes, with a heap of (rank, place)."""
        ids = [self.byte_ids[b] for b in raw]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            other = after[k] if ids[k] == left else n
            if other >= n or ids[other] != right:
                continue
            ids[k], ids[other] = merges[left, right][1], -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
                if (p := (ids[k], ids[after[k]])) in merges:
                    heapq.heappush(heap, (merges[p][0], k, *p))
            if before[k] >= 0 and (p := (ids[before[k]], ids[k])) in merges:
                heapq.heappush(heap, (merges[p][0], before[k], *p))
        return [x for x in ids if x >= 0]


class Transducer:
    """Bytes of one pre-token in, tokens out as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""

    def push(self, raw: bytes) -> list[int]:
        out: list[int] = []
        self.held += raw
        while len(self.held) > self.v.lookahead + WINDOW:
            window, final, at = self.held[: self.v.lookahead + WINDOW], len(self.held[: self.v.lookahead + WINDOW]) - self.v.lookahead, 0
            for k in self.v.merge_window(window):
                if at + len(self.v.bytes[k]) > final:
                    break
                out.append(k)
                at += len(self.v.bytes[k])
            self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        raw, self.held = self.held, b""
        return self.v.merge(raw) if len(raw) < 64 else self.v.merge_window(raw)


class _Memo(dict):
    """Bytes of the ids of a piece of text that nothing outside it can change."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            value = self.encode(piece)
        self[piece] = value
        return value

    def bounded(self) -> None:
        if len(self) > MEMO_WORDS:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Text in, in blocks; ids out as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.space = regex.compile(rf"[{_WS}]")
        self.runs = {k: regex.compile(p) for k, p in _RUNS.items()}
        self.hold = max([1, *(len(x) for x in self.v.specials)])
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.v.specials, key=len, reverse=True)) + ")") if self.v.specials else None
        self.tokens = _Memo(self._pretoken)
        self.first, self.later = _Memo(self._piece), _Memo(lambda x: self._piece(" " + x))
        self.newline = self._pretoken("\n")
        self.tail, self.open, self.kind = "", Transducer(vocabulary), ""

    def _pretoken(self, token: str) -> bytes:
        run = Transducer(self.v)
        return np.array(run.push(token.encode()) + run.close(), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.tokens[x] if len(x) < 64 else self._pretoken(x) for x in self.pattern.findall(piece)])

    def _plain(self, text: str) -> bytes:
        """A text that starts and ends between pre-tokens, without special tokens.

        No pre-token goes on over a single blank or line end between other characters, so the
        text is cut there and each piece is looked up.
        """
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _ODD)):
            return self._piece(text)
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.first[head] if len(head) < 256 else self._piece(head))
            if rest and max(map(len, rest)) < 256:
                out.append(b"".join(map(self.later.__getitem__, rest)))
            else:
                out += [self._piece(" " + x) for x in rest]
            out.append(self.newline)
        return b"".join(out[:-1])

    def _whole(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text) if text else b""
        parts = self.special.split(text)
        return b"".join(np.array([self.v.specials[x]], "<u4").tobytes() if k % 2 else self._plain(x) if x else b"" for k, x in enumerate(parts))

    def feed(self, text: str) -> bytes:
        """Ids that are final after this block."""
        out, self.tail = [], self.tail + text
        self.bounded()
        while len(self.tail) > FEED // 2:
            if self.kind:
                out.append(self._go_on(False))
                if self.kind:
                    break
                continue
            # A blank between two other characters is a safe place to cut.
            at = self.tail.rfind(" ", 1, len(self.tail) - 1)
            while at > 0 and (self.space.match(self.tail[at - 1]) or self.space.match(self.tail[at + 1])):
                at = self.tail.rfind(" ", 1, at)
            if at > 0:
                out.append(self._whole(self.tail[:at]))
                self.tail = self.tail[at:]
                # What follows the blank may be long; if it has no other blank, it is handled below.
                if len(self.tail) <= FEED // 2:
                    break
            found = self.special.search(self.tail) if self.special else None
            end = found.start() if found else len(self.tail) - self.hold - 4
            last = None
            for last in self.pattern.finditer(self.tail, 0, len(self.tail) if found is None else end):
                if last.end() >= end:
                    break
                out.append(self._pretoken(last.group()))
            if found and last is not None and last.end() <= end:
                out += [self._pretoken(last.group())] * (last.end() == end) + [np.array([self.v.specials[found.group()]], "<u4").tobytes()]
                self.tail = self.tail[found.end() :]
                continue
            if found:
                out.append(np.array([self.v.specials[found.group()]], "<u4").tobytes())
                self.tail = self.tail[found.end() :]
                continue
            self.tail = self.tail[last.start() :]
            if len(self.tail) <= FEED // 2:
                break
            body = last.group()[1:] if last.group()[0] == " " and len(last.group()) > 1 and not self.space.match(last.group()[1]) else last.group()
            self.kind = next(k for k, p in self.runs.items() if p.fullmatch(body))
            lead = len(last.group()) - len(body)
            out.append(np.array(self.open.push(self.tail[:lead].encode()), "<u4").tobytes())
            self.tail = self.tail[lead:]
        return b"".join(out)

    def _go_on(self, ended: bool) -> bytes:
        """More of the open pre-token; it ends where other characters follow, or the text."""
        stop = len(self.tail)
        if self.kind == "other" and self.special and (found := self.special.search(self.tail)):
            stop = found.start()
        run = self.runs[self.kind].match(self.tail, 0, stop).end()
        # A special token may be arriving, which parts the run from what follows.
        unsure = self.kind in ("space", "other") and len(self.tail) - run < self.hold
        over = ended or (run < len(self.tail) and not unsure)
        if not over:
            keep = run - (self.hold if self.kind == "other" else 1)
        else:
            # The last white space before other characters stands alone or joins them.
            joins = self.kind == "space" and run < len(self.tail) and not (self.special and self.special.match(self.tail, run))
            keep = run - joins
        ids = self.open.push(self.tail[: max(keep, 0)].encode())
        self.tail = self.tail[max(keep, 0) :]
        if over:
            ids += self.open.close()
            self.kind = ""
        return np.array(ids, "<u4").tobytes()

    def close(self) -> bytes:
        self.bounded()
        out = self._go_on(True) if self.kind else b""
        text, self.tail = self.tail, ""
        return out + self._whole(text)

    def encode(self, text: str) -> bytes:
        """All ids of a text, fed in blocks of FEED characters."""
        return b"".join([*(self.feed(text[k : k + FEED]) for k in range(0, len(text), FEED)), self.close()])

    def bounded(self) -> None:
        for memo in (self.tokens, self.first, self.later):
            memo.bounded()


class Decoder:
    """Ids in, text out. An incomplete character waits for its next byte; bytes that can't be
    text come out as U+FFFD, as does what is incomplete at the end."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def close(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        return "".join([*(self.feed(numbers[k : k + FEED].tolist()) for k in range(0, len(numbers), FEED)), self.close()])


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids binary) of every whole text; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(tokenizer_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_documents(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, text) of every row (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(token_bytes(tokenizer_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [decoder.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs`.

    Null and empty texts have no tokens and the digests of nothing; a null doc_id stays null. Rows
    that repeat a doc_id or a text are rows of their own. An empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(token_bytes(tokenizer_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1).to_pylist()
                text = [hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in ids]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(text)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encode_documents(docs, tokenizer_path)
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
