"""Spelling variants, shared lines and hard negatives against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.llm import hard_negatives, line_dedup, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, key long, form string, root string, ord long, th long, batch int, hashes int, gone int, kept string, sha string"
LONG = "verylongword" * 400 + " " + " ".join(f"{'abcdefgh'[k % 8]}some" for k in range(3000))
TEXTS = [(0, "Hello helo HELLO hello\nhallo Hällo hällo hällo"), (1, None), (2, ""), (3, " \n\t \n"), (4, LONG), (5, LONG), (5, "same id\nother"), (5, "same id\nother"), (None, "no id\nother"), (None, None), (6, "x\n" * 3), (7, "ünï 漢字 🙂")]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i == 2 else "s", None if t is None else len(t), *[None] * 12) for i, t in texts], SCHEMA)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(texts, plant=97):
    counts = Counter()
    for i, t in texts:
        for w in spelling.RUNS.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % plant == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def mined_words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    out = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            at = rng.randrange(len(w) + 1)
            words.append(rng.choice([w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :], w.upper()]))
        out.append((k, rng.choice([" ", ", ", "9", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("limit", [spelling.GROUP_WORDS, 3])
def test_spelling_matches_brute_force(spark, monkeypatch, limit):
    """Also where groups are cut into finer segments."""
    monkeypatch.setattr(spelling.near_words, "__defaults__", (limit,))
    texts = mined_words(1, 40) + TEXTS
    got = {tuple(r) for r in spelling.spelling_report(rows_of(spark, texts), plant=7).collect()}
    want = brute_spelling(texts, 7)
    assert got == want and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_of_odd_rows(spark):
    got = {tuple(r) for r in spelling.spelling_report(rows_of(spark, TEXTS)).collect()}
    assert got == brute_spelling(TEXTS)
    assert spelling.spelling_report(rows_of(spark, [])).count() == 0


@given(st.lists(st.text("abá", max_size=6), unique=True, max_size=30))
@settings(max_examples=200, deadline=None)
def test_scan_finds_all_near_pairs(words):
    words = sorted(words)
    assert set(spelling.near_pairs(words)) == {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}


def test_pieces_keep_runs_whole():
    text = "abc de fgh " * 50 + "x" * 100 + " y"
    parts = list(spelling.pieces(text, 7))
    assert "".join(parts) == text and [w for p in parts for w in spelling.RUNS.findall(p)] == spelling.RUNS.findall(text)


def brute_lines(texts, least):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 10])
def test_lines_match_brute_force(spark, least):
    rng = random.Random(least)
    texts = TEXTS + [(100 + k, "\n".join(rng.choice([" Common", "common\t", "COMMON ÉCOLE", "common École", "", " ", f"own {k}", f"mod {k % 9}"]) for _ in range(rng.randint(0, 8)))) for k in range(90)]
    got = sorted((tuple(r) for r in line_dedup.line_report(rows_of(spark, texts), least).collect()), key=str)
    assert got == brute_lines(texts, least) and sum(r[2] for r in got) > 50
    assert line_dedup.line_report(rows_of(spark, []), least).count() == 0


def test_runs_are_compacted_and_tell_what_is_new(spark):
    runs = line_dedup.LineRuns(spark, least=3, fanout=2)
    batches = [[[1, 2]], [[2, 3]], [[2], [4]], [[2, 5]], [[5], [5, 2]]]
    for own in batches:
        lines = spark.createDataFrame([([{"h1": x, "h2": -x} for x in row],) for row in own], "hashes array<struct<h1:long,h2:long>>")
        counts = lines.select(F.inline("hashes")).distinct()
        seen = {x for rows in batches[: batches.index(own)] for row in rows for x in row}
        assert {r["h1"] for r in runs.unseen(counts).collect()} == {x for row in own for x in row} - seen
        runs.add(lines)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r["h1"] for r in runs.frequent().collect()} == {2, 5}
    assert line_dedup.LineRuns(spark).frequent().count() == 0


def test_documents_without_lines_keep_rows_and_columns(spark):
    docs = rows_of(spark, TEXTS)
    out = line_dedup.without_lines(docs, 3)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.where("doc_id in (1, 5, 7) and coalesce(n_chars, 0) < 20").collect()), key=str)
    assert got == [(1, None, None), (5, "same id", 7), (5, "same id", 7), (7, "ünï 漢字 🙂", 8)]


def brute_negatives(rows, every=50):
    own = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, v in own:
        if i % every:
            continue
        found = sorted((-dot(v, w), j) for j, m, w in own if m == label and j != i)[:5]
        for s, j in found:
            negatives = sorted((-dot(v, w), k) for k, m, w in own if m != label and -50 * s <= 100 * dot(v, w) <= -95 * s)
            out |= {(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(negatives[:3])}
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1) for i, e, label in rows], "vec_id long, embedding array<float>, label int, shard string, id int")


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_negatives_match_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(hard_negatives.shards_of, "__defaults__", (shard_rows,))
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "FANOUT", 2)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 6))
    rows = [(k, (centres[k % 4] + rng.standard_normal(6) * 0.5).tolist(), int(k % 3)) for k in range(300)]
    rows += [(300 + k, [0.5, 0.25, 0.0, 0.0, 0.0, 1.0], k % 2) for k in range(120)]
    rows += [(1000, None, 1), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1100, [float("nan")] * 6, 1), (1150, [1.0] * 6, None), (1200, [float("inf")] * 6, 2), (1250, [0.0] * 6, 2), (1300, [], 1), (1350, [2.0, 1.0], 0)]
    got = [tuple(r) for r in hard_negatives.hard_negatives(vectors_of(spark, rows)).select(*COLUMNS).collect()]
    want = brute_negatives(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_negatives_of_few_rows(spark):
    none = hard_negatives.hard_negatives(vectors_of(spark, []))
    assert none.columns == COLUMNS and none.count() == 0
    assert hard_negatives.hard_negatives(vectors_of(spark, [(50, [1.0], 1)])).count() == 0


def test_intervals_hold_every_product():
    rng = np.random.default_rng(0)
    a, v = rng.integers(-99, 99, (5, 7)), rng.integers(-99, 99, (40, 7))
    least, most = hard_negatives.intervals(a, v.min(0)[None], v.max(0)[None])
    scores = a @ v.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    order = hard_negatives.packed_order(v, 8)
    assert sorted(order.tolist()) == list(range(40))
