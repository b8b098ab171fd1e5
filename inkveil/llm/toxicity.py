"""Operator 2: a linear-chain conditional random field that tags toxic words.

Labels mark whole documents. Words are labelled from them: in a toxic document, the words whose
text or first letters are most over-represented in toxic documents (G-squared, next to the best
word of the same document). The field has the states clean and toxic; forward-backward gives
each word's odds, and a logistic curve fitted on the training documents turns the largest odds and
the expected number of toxic words into a document's score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import text_of, written

#: Bounds of the sample of labelled documents that the field is fitted on: texts, and words of all
#: of them, of each label. A text of more than a tenth of those words isn't taken, so that it doesn't
#: keep out all others.
TRAIN_TOXIC = 1500
TRAIN_CLEAN = 2500
TRAIN_WORDS = 1_500_000
#: Features kept to label words with, and weights of the field.
LEXICON = 20_000
WEIGHTS = 1 << 17
ROUNDS = 25
#: Words whose marginals are worked out at once while fitting.
FIT_WORDS = 1 << 17
#: Characters of the texts that are scored at once; a longer text is scored in pieces of so many.
SCORE_CHARS = 1 << 19
#: Rows that leave Arrow's columns at once.
SCORE_ROWS = 256
#: Words remembered with their weights by each Python worker; beyond it the memory starts anew.
MEMO_WORDS = 250_000
BLOCK = 64
#: Marks that don't count at the ends of a word.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u3001\u3002"
#: Characters of a word that features are hashed from; a longer one is told by its ends and its crc.
_LONG = 40
#: The slot of a feature that a word doesn't have (its weight stays 0), and that of every word.
_NONE, _BIAS = WEIGHTS, WEIGHTS + 1
_SLOTS = WEIGHTS + 2
_POWERS = np.cumprod(np.full(_LONG + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def stems(word: str) -> list[str]:
    """The word and its first 3, 4 and 5 letters, as features to label words with."""
    w = word.strip(_MARKS)
    return [f"w:{w}", *(f"{k}:{w[:k]}" for k in (3, 4, 5) if len(w) > k)] if w else []


def features(words: list[str]) -> np.ndarray:
    """Slots of every word's features: the word, its last 3 letters, its first 3, 4 and 5, the one
    that every word has; then those that it is to the word after it and to the word before it."""
    bare = [w.strip(_MARKS) for w in words]
    bare = [w if len(w) <= _LONG else f"{w[:20]}{zlib.crc32(w.encode()):08x}{w[-3:]}" for w in bare]
    out = np.full((len(bare), 8), _NONE, np.int32)
    out[:, 5] = _BIAS
    if not bare:
        return out
    text = np.array(bare, dtype=f"<U{max(1, max(map(len, bare)))}")
    codes = text.view(np.uint32).reshape(len(bare), -1).astype(np.uint64)
    n = (codes > 0).sum(1)
    sums = np.cumsum(codes * _POWERS[: codes.shape[1]], axis=1, dtype=np.uint64)
    whole = sums[:, -1]
    row = np.arange(len(bare))
    last = sum(codes[row, np.maximum(n - 1 - k, 0)] * (n > k) * _POWERS[k] for k in range(3))

    def slot(kind: int, x: np.ndarray) -> np.ndarray:
        x = (x ^ np.uint64(kind * 0x9E3779B1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(40)).astype(np.int32) % WEIGHTS

    some = n > 0
    out[some, 0], out[some, 1] = slot(1, whole)[some], slot(2, last)[some]
    for k in (3, 4, 5):
        if codes.shape[1] > k:
            longer = n > k
            out[longer, k - 1] = slot(k, sums[:, k - 1])[longer]
    out[:, 6], out[:, 7] = slot(6, whole), slot(7, whole)
    return out


@dataclass
class Field:
    """Weights of the features, scores of transitions and starts, and the document's curve."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    curve: np.ndarray

    def steps(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The transfer matrix of every word (2 x 2); a text's first word forgets what was before."""
        e = np.clip(emission, -40, 40)
        out = np.empty((len(e), 2, 2))
        out[:, :, 0] = np.exp(self.moves[:, 0])
        out[:, :, 1] = np.exp(self.moves[:, 1])
        out[first] = np.exp(self.start)
        out[:, :, 1] *= np.exp(e)[:, None]
        return out / out.max((1, 2), keepdims=True)


Pair = tuple[float, float]


def forward_backward(steps: np.ndarray, before: Pair = (0.5, 0.5), after: Pair = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors of every word, each summing to 1, of all texts in a row.

    `before` is the forward vector of the word before the first, `after` the backward one of the last.
    Blocks of BLOCK words are multiplied side by side, their products are chained, and then all
    blocks are filled in side by side.
    """
    n = len(steps)
    blocks = -(-n // BLOCK)
    padded = np.broadcast_to(np.eye(2), (blocks * BLOCK, 2, 2)).copy()
    padded[:n] = steps
    grid = padded.reshape(blocks, BLOCK, 2, 2).transpose(1, 2, 3, 0).copy()
    product = grid[0].copy()
    for k in range(1, BLOCK):
        a, m = product, grid[k]
        product = np.stack([np.stack([a[i, 0] * m[0, j] + a[i, 1] * m[1, j] for j in (0, 1)]) for i in (0, 1)])
        product /= product.max((0, 1))
    flat = product.reshape(4, blocks).T.tolist()
    entry, (x, y) = [], before
    for a, b, c, d in flat:
        entry.append((x, y))
        x, y = x * a + y * c, x * b + y * d
        s = x + y
        x, y = x / s, y / s
    leave, (x, y) = [], after
    for a, b, c, d in reversed(flat):
        leave.append((x, y))
        x, y = a * x + b * y, c * x + d * y
        s = x + y
        x, y = x / s, y / s
    alpha, beta = np.empty((BLOCK, 2, blocks)), np.empty((BLOCK, 2, blocks))
    now = np.array(entry).T
    for k in range(BLOCK):
        now = now[0] * grid[k][0] + now[1] * grid[k][1]
        now = now / now.sum(0)
        alpha[k] = now
    now = np.array(leave[::-1]).T
    for k in range(BLOCK - 1, -1, -1):
        beta[k] = now
        now = grid[k][:, 0] * now[0] + grid[k][:, 1] * now[1]
        now = now / now.sum(0)
    shape = lambda z: z.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return shape(alpha), shape(beta)


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    both = alpha * beta
    return both[:, 1] / both.sum(1)


def document_signs(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(1, logit of the largest odds, log of 1 + expected toxic words) of each text."""
    out = np.zeros((len(bounds) - 1, 3))
    out[:, 0], out[:, 1] = 1, -16
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = signs_of(np.maximum.reduceat(odds, bounds[:-1][full]), np.add.reduceat(odds, bounds[:-1][full]))
    return out


def signs_of(top: np.ndarray | float, total: np.ndarray | float) -> np.ndarray:
    """The signs of texts with words, from their largest odds and the sum of all odds."""
    top = np.clip(top, 1e-7, 1 - 1e-7)
    return np.stack([np.ones_like(top), np.log(top / (1 - top)), np.log1p(total)], -1)


def _fit_curve(signs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    curve = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(signs @ curve, -30, 30)))
        slope = signs.T @ (labels - p) - 0.05 * curve
        bend = (signs * (p * (1 - p))[:, None]).T @ signs + 0.05 * np.eye(3)
        curve = curve + np.linalg.solve(bend, slope)
    return curve


def fit(texts: list[str], labels: list[int], lexicon: dict[str, float]) -> Field:
    """Fits the field on bounded samples by gradient ascent with a step for each weight.

    Marginals are worked out for FIT_WORDS words (or one longer text) at a time, so that memory
    follows the sample's distinct words. Without words, or features that tell toxic texts apart,
    the field scores every text alike, low.
    """
    number: dict[str, int] = {}
    ids, bounds = array("i"), [0]
    for text in texts:
        ids.extend([number.setdefault(w, len(number)) for w in text.lower().split()])
        bounds.append(len(ids))
    field = Field(np.zeros(_SLOTS), np.zeros((2, 2)), np.zeros(2), np.array([-4.0, 0.0, 0.0]))
    if not ids or not lexicon:
        return field
    ids, bounds = np.frombuffer(ids, np.int32), np.array(bounds)
    gain = np.array([max((lexicon.get(s, 0.0) for s in stems(w)), default=0.0) for w in number])
    words = list(number)
    cells = np.concatenate([features(words[k : k + 50_000]) for k in range(0, len(words), 50_000)])
    del number, words
    first = np.zeros(len(ids) + 1, bool)
    first[bounds] = True
    truth = np.zeros(len(ids), bool)
    for k in np.flatnonzero(np.array(labels, bool) & (np.diff(bounds) > 0)):
        g = gain[ids[bounds[k] : bounds[k + 1]]]
        truth[bounds[k] : bounds[k + 1]] = g >= max(10.0, 0.3 * g.max())
    parts = [0]
    for k in range(1, len(bounds)):
        if bounds[k] - bounds[parts[-1]] > FIT_WORDS and parts[-1] < k - 1:
            parts.append(k - 1)
    parts.append(len(bounds) - 1)
    pieces = list(zip(parts, parts[1:]))
    seen = [np.zeros(_SLOTS), np.zeros((2, 2)), np.zeros(2)]
    for _ in range(ROUNDS):
        scores = word_scores(field, cells)
        by_word = np.zeros((3, len(cells)))
        moved, begun = np.zeros((2, 2)), np.zeros(2)
        for a, z in pieces:
            own, top = ids[bounds[a] : bounds[z]], first[bounds[a] : bounds[z] + 1]
            y = truth[bounds[a] : bounds[z]].astype(int)
            steps = field.steps(emissions(scores, own, top), top[:-1])
            alpha, beta = forward_backward(steps)
            p = marginals(alpha, beta)
            pull = y - p
            by_word[0] += np.bincount(own, pull, len(cells))
            by_word[1] += np.bincount(own[:-1], pull[1:] * ~top[1:-1], len(cells))
            by_word[2] += np.bincount(own[1:], pull[:-1] * ~top[1:-1], len(cells))
            inner = np.flatnonzero(~top[:-1])
            pair = alpha[inner - 1][:, :, None] * steps[inner] * beta[inner][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moved += np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2) - pair.sum(0)
            starts = pull[top[:-1]].sum()
            begun += [-starts, starts]
        grad = sum(np.bincount(cells[:, k], by_word[max(0, k - 5)], _SLOTS) for k in range(8))
        grad[_NONE] = 0
        for value, slope, square in zip((field.weights, field.moves, field.start), (grad - 0.01 * field.weights, moved - 0.01 * field.moves, begun - 0.01 * field.start), seen):
            square += slope * slope
            value += 0.7 * slope / np.sqrt(square + 1e-6)
    scores = word_scores(field, cells)
    signs = []
    for a, z in pieces:
        own, top = ids[bounds[a] : bounds[z]], first[bounds[a] : bounds[z] + 1]
        odds = marginals(*forward_backward(field.steps(emissions(scores, own, top), top[:-1])))
        signs.append(document_signs(odds, bounds[a : z + 1] - bounds[a]))
    field.curve = _fit_curve(np.concatenate(signs), np.array(labels, float))
    return field


def word_scores(field: Field, cells: np.ndarray) -> np.ndarray:
    """What each word (a row of slots) adds to its own score, the next word's and the last one's."""
    w = field.weights
    return np.stack([w[cells[:, :6]].sum(1), w[cells[:, 6]], w[cells[:, 7]]])


def emissions(scores: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The score for toxic of each word of texts in a row. `first` has an entry more than `ids`."""
    out = scores[0][ids]
    out[1:] += scores[1][ids[:-1]] * ~first[1:-1]
    out[:-1] += scores[2][ids[1:]] * ~first[1:-1]
    return out


class _Known(dict):
    """The number of each word in `scores`, which `filled` brings up to date."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.new: list[str] = []
        self.scores = np.zeros((3, 1 << 16))

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.new.append(word)
        return value

    def filled(self) -> np.ndarray:
        at = len(self) - len(self.new)
        while self.scores.shape[1] < len(self):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)], axis=1)
        for k in range(0, len(self.new), 50_000):
            part = self.new[k : k + 50_000]
            self.scores[:, at + k : at + k + len(part)] = word_scores(self.field, features(part))
        self.new.clear()
        return self.scores

    def bounded(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


def score_texts(field: Field, known: _Known, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The score and the toxic words' (start, end) of each whole text, in characters.

    Texts are scored together up to SCORE_CHARS characters, and a longer one in pieces, so that memory
    beside the texts doesn't follow their number or length.
    """
    scores, spans = np.zeros(len(texts)), []
    at, held = 0, 0
    for k, text in enumerate(texts):
        if k > at and held + len(text) > SCORE_CHARS:
            scores[at:k], found = _score_group(field, known, texts[at:k])
            spans += found
            at, held = k, 0
        held += len(text)
        if held > SCORE_CHARS:
            scores[k], found = _score_long(field, known, text)
            spans.append(found)
            at, held = k + 1, 0
    if at < len(texts):
        scores[at:], found = _score_group(field, known, texts[at:])
        spans += found
    return scores, spans


def _score(signs: np.ndarray, field: Field) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(signs @ field.curve, -30, 30)))


def _score_group(field: Field, known: _Known, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    known.bounded()
    words = [t.lower().split() for t in texts]
    bounds = np.cumsum([0, *map(len, words)])
    n = int(bounds[-1])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    odds = np.zeros(n)
    if n:
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, n)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        odds = marginals(*forward_backward(field.steps(emissions(known.filled(), ids, first), first[:n])))
        hits = np.flatnonzero(odds >= 0.5)
        for k in np.unique(np.searchsorted(bounds, hits, "right") - 1):
            spans[k] = _places(texts[k], hits[(hits >= bounds[k]) & (hits < bounds[k + 1])] - bounds[k])
    return _score(document_signs(odds, bounds), field), spans


def _places(text: str, hits: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the words of these numbers, which ascend."""
    wanted = iter(hits.tolist())
    out, at = [], next(wanted, None)
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if at is None:
            break
        if k == at:
            out.append(m.span())
            at = next(wanted, None)
    return out


def cut_at_blanks(text: str) -> Iterator[str]:
    """The text in pieces of SCORE_CHARS characters and what is left of the word at their end."""
    blank, at = re.compile(r"\s"), 0
    while at < len(text):
        m = blank.search(text, at + SCORE_CHARS)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def _score_long(field: Field, known: _Known, text: str) -> tuple[float, list[tuple[int, int]]]:
    """The score and spans of one text, a piece at a time; between pieces 8 bytes a word are kept.

    The pieces' scores of words come first, from left to right. Then backward vectors go from
    the last piece to the first, and forward ones with all odds from the first to the last.
    """
    pieces: list[np.ndarray] = []
    onward = 0.0
    for part in cut_at_blanks(text):
        words = part.lower().split()
        if not words:
            continue
        known.bounded()
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        own = known.filled()
        first = np.zeros(len(ids) + 1, bool)
        emission = emissions(own, ids, first)
        emission[0] += onward
        if pieces:
            pieces[-1][-1] += own[2][ids[0]]
        onward = own[1][ids[-1]]
        pieces.append(emission)
    if not pieces:
        return float(_score(document_signs(np.zeros(0), np.array([0, 0])), field)[0]), []

    def steps_of(k: int) -> np.ndarray:
        first = np.zeros(len(pieces[k]), bool)
        first[0] = k == 0
        return field.steps(pieces[k], first)

    after: list[Pair] = [(0.5, 0.5)] * len(pieces)
    for k in range(len(pieces) - 1, 0, -1):
        steps = steps_of(k)
        beta = forward_backward(steps, after=after[k])[1][0]
        x = steps[0] @ beta
        after[k - 1] = tuple(x / x.sum())
    before: Pair = (0.5, 0.5)
    top, total, at, hits = 0.0, 0.0, 0, []
    for k in range(len(pieces)):
        alpha, beta = forward_backward(steps_of(k), before, after[k])
        before = tuple(alpha[-1])
        odds = marginals(alpha, beta)
        top, total = max(top, float(odds.max())), total + float(odds.sum())
        hits.append(np.flatnonzero(odds >= 0.5) + at)
        at += len(odds)
    return float(_score(signs_of(top, total), field)), _places(text, np.concatenate(hits))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled texts that aren't held out.

    Equal texts are one, and toxic if any of their labels says so; so are rows of `labels` that
    repeat a doc_id. Rows without a doc_id or a label don't count, nor do null texts. The sample
    follows a hash of the text: of each label at most TRAIN_TOXIC or TRAIN_CLEAN texts, up to
    TRAIN_WORDS words together. No text is shuffled; as many hashes as texts are broadcast.
    """
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = usable.where(F.crc32(F.col("label_id").cast("string")) % 3 != 1)
    text = docs["text"].cast("string")
    rows = docs.where(text.isNotNull()).select(docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(text).alias("th"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n"))
    texts = rows.where(f"n <= {TRAIN_WORDS // 10}").join(usable, F.col("own_id") == F.col("label_id")).groupBy("th").agg(F.max("toxic").alias("toxic"), F.max("n").alias("n"))
    order = [F.xxhash64("th"), F.col("th")]
    picked = [texts.where("toxic > 0" if k else "toxic <= 0").orderBy(*order).limit(most) for k, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    #: A window over no more rows than the bounds say.
    running = F.sum("n").over(Window.partitionBy("toxic").orderBy(*order))
    picked = picked[0].unionByName(picked[1]).withColumn("toxic", (F.col("toxic") > 0).cast("int")).withColumn("words", running).where(f"words <= {TRAIN_WORDS}")
    picked = written(picked.select(F.col("th").alias("picked_th"), "toxic"), "picked")
    own = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("th"), text.alias("text")).join(F.broadcast(picked), F.col("th") == F.col("picked_th"))
    return own.groupBy("th").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def lexicon_of(rows: DataFrame) -> dict[str, float]:
    """The LEXICON features most over-represented in toxic texts, with their G-squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list({s for w in set(text.lower().split()) for s in stems(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["feature", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    found = rows.mapInArrow(run, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    share = n1 / (n1 + n0)
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    b = n - a
    gain = 2 * (a * F.log((a + 1e-9) / (n * share)) + b * F.log((b + 1e-9) / (n * (1 - share))))
    top = found.where((a >= 4) & (a / n > (1 + share) / 2)).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(LEXICON)
    return {r["feature"]: r["gain"] for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, fitted in one task on the bounded sample; only its weights reach the driver."""
    rows = written(training_rows(docs, labels), "labelled")
    lexicon = lexicon_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda k: (zlib.crc32(texts[k].encode()), texts[k]))
        field = fit([texts[k] for k in order], [marks[k] for k in order], lexicon)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (field.weights, field.moves, field.start, field.curve)], ["weights", "moves", "start", "curve"])

    row = rows.repartition(1).mapInArrow(run, "weights binary, moves binary, start binary, curve binary").first()
    if row is None:
        return fit([], [], {})
    own = [np.frombuffer(x, "<f8").copy() for x in row]
    return Field(own[0].astype(np.float32).astype(float), own[1].reshape(2, 2), own[2], own[3])


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (offsets of toxic words) of every row.

    Scores depend on the text alone. Null and empty texts have no words: they get the score of a
    text without toxic words. Very long texts are scored whole, in pieces. Rows without a doc_id
    aren't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(field)
        for batch in batches:
            for at in range(0, batch.num_rows, SCORE_ROWS):
                part = batch.slice(at, SCORE_ROWS)
                score, spans = score_texts(field, known, part.column(1).to_pylist())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                own = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), own], ["doc_id", "score", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def accepted(docs: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose score is below `threshold`, with all their columns, in place.

    Only texts go to Python. Null and empty texts score as scored() says, repeated rows alike; an
    empty table gives none.
    """

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(field)
        for texts in batches:
            parts = [score_texts(field, known, texts.iloc[at : at + SCORE_ROWS].tolist())[0] for at in range(0, len(texts), SCORE_ROWS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(toxic(text_of(docs)) < threshold)
