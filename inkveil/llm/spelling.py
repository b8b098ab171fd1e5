"""Operator 11: spelling variants, words one edit apart, found by dynamic programming over sorted words.

Words meet where an edit leaves them alike: the longer word of a pair is cut into segments, and a pair
whose edit lies in one segment agrees in all before and after it. So each word goes to one group for each
segment; groups with too many words are cut into finer segments. Within a group the words are scanned in
order: rows of the edit matrix, three cells wide, are kept as far as a word agrees with the one before it,
and words that share a prefix which is more than one edit away already are passed over together.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import text_of, written

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form occurs at least so many times as often.
FORM_RATIO = 2
#: Every so many distinct (doc_id, word)s one loses a code point, by a checksum; 0: none.
PLANT = 97
#: Words that a Python worker counts before it hands them on, and code points that it takes up at once.
MEMO_WORDS = 400_000
PIECE = 1 << 20
#: Segments are halved LEVEL times at first, and again in groups of more than GROUP_WORDS words.
LEVEL = 2
GROUP_WORDS = 256


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` code points that don't cut a run of letters."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class WordCounts:
    """Counts of words, with those planted errors that depend on doc_id and word.

    The checksum of a doc_id's prefix and a word is that of the word, changed by what depends on the
    prefix and the word's length alone; so the words' own checksums are worked out once.
    """

    LONG = 64

    def __init__(self, plant: int):
        self.plant = plant
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words, self.crc, self.size = [], [], []
        self.counts = np.zeros(MEMO_WORDS // 4, np.int64)

    def _id(self, word: str) -> int:
        k = self.ids.get(word)
        if k is None:
            k = self.ids[word] = len(self.words)
            raw = word.encode()
            self.words.append(word)
            self.crc.append(zlib.crc32(raw))
            self.size.append(len(raw))
            if k == len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros(k, np.int64)])
        return k

    def add(self, doc_id: str, text: str) -> None:
        # Only A-Z become small, as bytes do.
        own = np.array([self._id(w) for w in RUNS.findall(text.encode().lower().decode())], np.int64)
        if not len(own):
            return
        used, n = np.unique(own, return_counts=True)
        self.counts[used] += n
        if not self.plant:
            return
        sizes, sums = (np.array([x[k] for k in used.tolist()], np.int64) for x in (self.size, self.crc))
        prefix = f"{doc_id}:".encode()
        turned = np.array([zlib.crc32(prefix + bytes(k)) ^ zlib.crc32(bytes(k)) for k in range(min(int(sizes.max()), self.LONG) + 1)], np.int64)
        sums ^= turned[np.minimum(sizes, self.LONG)]
        for k in np.flatnonzero((sums % self.plant == 0) | (sizes > self.LONG)).tolist():
            word = self.words[used[k]]
            h = zlib.crc32(prefix + word.encode())
            if h % self.plant == 0:
                at = h % len(word)
                other = self._id(word[:at] + word[at + 1 :])
                self.counts[used[k]] -= n[k]
                self.counts[other] += n[k]

    def rows(self) -> tuple[list[str], list[int]]:
        kept = [k for k in np.flatnonzero(self.counts[: len(self.words)]).tolist() if self.words[k]]
        out = [self.words[k] for k in kept], self.counts[kept].tolist()
        self.clear()
        return out


def vocabulary(docs: DataFrame, plant: int = PLANT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(plant)

        def flushed() -> pa.RecordBatch:
            words, n = counts.rows()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in pieces(text.as_py()):
                    counts.add(doc_id, piece)
                    if len(counts.ids) > MEMO_WORDS:
                        yield flushed()
        yield flushed()

    own = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), text_of(docs).alias("text"))
    rows = own.mapInArrow(run, "word string, n long").where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bound(longer: Column, segment: Column, level: int) -> Column:
    return F.floor(longer * segment / (1 << level)).cast("int")


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """rows (longer, segment, word, n) with the key of their group; segments without width go."""
    low, high = (_bound(F.col("longer"), F.col("segment") + k, level) for k in (0, 1))
    tail = F.col("longer") - high
    before = F.substring("word", F.lit(1), low)
    after = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    return rows.where(low < high).withColumns({"key": F.xxhash64("longer", "segment", before, after), "high": high, "wide": high - low > 1})


def segments_of(words: DataFrame) -> DataFrame:
    """Each word (word, n) in the groups of its pairs: `longer` is the length of the longer of a pair."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    rows = words.select("word", "n", longer).select("word", "n", "longer", F.explode(F.sequence(F.lit(0), F.lit((1 << LEVEL) - 1))).alias("segment"))
    return _keyed(rows, LEVEL)


def _transitions() -> tuple[list[list[int]], int, int, list[tuple[int, int, int]]]:
    """The next row of the matrix for each row and for which of three letters agree.

    A row holds, for a prefix of d letters of the list's word, its distance to the query's first d - 1, d
    and d + 1 letters, each 2 where it is more than 1.
    """
    rows = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    number = {r: k for k, r in enumerate(rows)}
    table = []
    for left, mid, right in rows:
        out = []
        for same in range(8):
            first = min(left + (not same & 1), mid + 1, 2)
            second = min(mid + (not same & 2), right + 1, first + 1, 2)
            third = min(right + (not same & 4), second + 1, 2)
            out.append(number[first, second, third])
        table.append(out)
    return table, number[1, 0, 1], number[2, 2, 2], rows


_NEXT, _EQUAL, _DEAD, _CELLS = _transitions()


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs (i, j), i < j, of sorted distinct words that are exactly one edit apart."""
    m = len(words)
    lcp = [0] + [shared_prefix(a, b) for a, b in zip(words, words[1:])]
    rows = [_EQUAL] * (max(map(len, words), default=0) + 1)
    for i in range(m - 1):
        own = words[i]
        query, length = own + "\0\0", len(own)
        # As far as the next word agrees with the query, its rows are those of equal prefixes.
        valid = lcp[i + 1]
        for k in range(valid + 1):
            rows[k] = _EQUAL
        j = i + 1
        while j < m:
            word = words[j]
            d = valid if valid < lcp[j] else lcp[j]
            row = rows[d]
            end = len(word) if len(word) < length + 2 else length + 2
            while d < end:
                c = word[d]
                row = _NEXT[row][(d > 0 and query[d - 1] == c) | (d < length and query[d] == c) << 1 | (d + 1 < length and query[d + 1] == c) << 2]
                d += 1
                rows[d] = row
                if row == _DEAD:
                    break
            valid = d
            apart = length - len(word)
            if row != _DEAD and d == len(word) and -1 <= apart <= 1 and _CELLS[row][1 + apart] == 1:
                yield i, j
            j += 1
            if row == _DEAD and j < m and lcp[j] >= d:
                # All words that share these d letters are more than one edit away.
                j = bisect_left(words, word[:d] + "\U0010ffff", j)


def scanned_groups(rows: DataFrame) -> DataFrame:
    """(word, near, best): of each word in a group, its number of near words there, and of these the
    one of largest n. rows: key, longer, segment, high, word, n."""
    dealt = rows.select("key", "longer", "segment", "high", "word", "n").repartition("key").sortWithinPartitions("key", "longer", "segment", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best_of(group: tuple[int, list[str], list[int]]) -> None:
            (longer, high), words, counts = group
            near, best = {}, {}
            for i, j in near_pairs(words):
                a, b = words[i], words[j]
                # Of the segments that an edit may be said to lie in, the one where the words part counts.
                if max(len(a), len(b)) != longer or shared_prefix(a, b) >= high:
                    continue
                for x, y in ((i, j), (j, i)):
                    near[x] = near.get(x, 0) + 1
                    if x not in best or (-counts[y], words[y]) < (-counts[best[x]], words[best[x]]):
                        best[x] = y
            for x, k in near.items():
                out[0].append(words[x])
                out[1].append(k)
                out[2].append(words[best[x]])
                out[3].append(counts[best[x]])

        held: list = [None, [], []]
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["word", "near", "form", "form_n"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            keys = [c.to_pylist() for c in batch.columns[:4]]
            for key, longer, segment, high, word, n in zip(*keys, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                own = (key, longer, segment, high)
                if own != held[0]:
                    if len(held[1]) > 1:
                        best_of(((held[0][1], held[0][3]), held[1], held[2]))
                    held = [own, [], []]
                held[1].append(word)
                held[2].append(n)
            if len(out[0]) > 10_000:
                yield flushed()
        if len(held[1]) > 1:
            best_of(((held[0][1], held[0][3]), held[1], held[2]))
        yield flushed()

    return dealt.mapInArrow(run, "word string, near long, form string, form_n long")


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, form, form_n): the number of near words of each word that has any, and the one of
    largest n, the smallest in code-point order among equals."""
    rows, level, found = segments_of(words), LEVEL, None
    while True:
        sizes = rows.where("wide").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group_words)
        hot = written(sizes.select("key"), "groups")
        if hot.isEmpty():
            done = scanned_groups(rows)
            found = done if found is None else found.unionByName(done)
            break
        done = scanned_groups(rows.join(hot, "key", "left_anti"))
        found = done if found is None else found.unionByName(done)
        again = rows.join(hot, "key", "left_semi").select("word", "n", "longer", F.explode(F.array(F.col("segment") * 2, F.col("segment") * 2 + 1)).alias("segment"))
        level += 1
        rows = written(_keyed(again, level), "segments")
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    own = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return own.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.order")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, form, ...) plus `root`, the last word that forms lead to from each.

    A form is more frequent than its word, so they end; each round doubles the steps taken.
    """
    steps = written(words.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(after, "root", "left")
        longer = written(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_report(docs: DataFrame, plant: int = PLANT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least LEAST_LENGTH code points and
    LEAST_COUNT occurrences in `docs`.

    Null texts have no words; a null doc_id is the empty text in the planted errors' checksum. Rows that
    repeat count each time. Of near words equally frequent the smallest in code-point order is the form.
    An empty table gives no rows.
    """
    words = written(vocabulary(docs, plant), "words")
    near = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    near = near.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))})
    out = with_roots(written(near, "near"))
    return out.select("word", "form", "root", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: Bytes of a word in UTF-8 and its CRC-32, by a table made by the polynomial's rule.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)) r) q),
runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) x GROUP BY 1, 2),
coded AS (
  SELECT doc_id, w, n, list_prepend(4294967295, CAST(flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS BIGINT[])) AS bytes FROM runs),
hashed AS (
  SELECT w, n, xor(list_reduce(bytes, lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256)), 4294967295) AS h FROM coded, tab),
planted AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
voc AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM planted WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM voc, unnest(range(1, length(word) + 1)) t(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM del d JOIN voc v ON v.word = d.rest
  UNION SELECT v.word, d.word, d.n FROM del d JOIN voc v ON v.word = d.rest),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS k FROM pairs),
near AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.b END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n FROM voc v LEFT JOIN ranked r ON r.a = v.word AND r.k = 1),
walk AS (SELECT word, word AS at FROM near UNION SELECT w.word, n.form FROM walk w JOIN near n ON n.word = w.at WHERE n.form IS NOT NULL)
SELECT n.word, n.form, w.at AS root, n.n, n.n_near, n.form_n FROM near n JOIN walk w ON w.word = n.word JOIN near e ON e.word = w.at AND e.form IS NULL
"""
