"""Operator 4 on all documents of the small table, against the same sums by hand."""

import re
from collections import Counter

import numpy as np
import xxhash

import __spark_entry__ as entry
from inkveil.llm import multiset_hash


def pieces(text):
    lines = [re.findall(r"[^ \t\n\x0b\f\r]+", line) for line in text.split("\n")]
    return [" ".join(w[k : k + 2]) for w in lines if w for k in range(max(len(w) - 1, 1))]


def signed(x):
    return (x + 2**31) % 2**32 - 2**31


def lanes_by_hand(text):
    lines, own = [line.encode() for line in text.split("\n") if line], pieces(text)
    h1 = [xxhash.xxh64_intdigest(x, 42) for x in lines]
    h2 = [xxhash.xxh64_intdigest(x, xxhash.xxh64_intdigest(b"paragraph", 42)) for x in lines]
    out = [sum(x % 2**32 for x in h1), sum(x >> 32 for x in h1), sum(x % 2**32 for x in h2), sum(x >> 32 for x in h2), len(lines), len(own)]
    lanes = [0] * multiset_hash.LANES
    for piece in own:
        h = xxhash.xxh64_intdigest(piece.encode(), 42)
        slot = (h - 2**64 if h >= 2**63 else h) % (2 * multiset_hash.LANES)
        lanes[slot // 2] += 1 if slot % 2 == 0 else -1
    return [signed(x) for x in out] + lanes


def exact(a, b):
    a, b = Counter(pieces(a)), Counter(pieces(b))
    squares = sum(n * n for n in a.values()) + sum(n * n for n in b.values())
    return 2 * sum(n * b[x] for x, n in a.items()) / squares if squares else 0.0


def test_all_fingerprints_and_the_error_of_likeness(spark, folder):
    got = {r["doc_id"]: r for r in entry.queries()["op4_multiset_hash"](spark, folder).collect()}
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    assert len(got) == len(docs)
    edited_errors, next_errors = [], []
    for k, (doc_id, text) in enumerate(docs):
        after, r = docs[(k + 1) % len(docs)][1], got[doc_id]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        for t, f in ((text, "fingerprint"), (edited, "edited_fingerprint")):
            assert r[f] == ",".join(map(str, lanes_by_hand(t)))
        edited_errors.append(r["near_edited"] - (1.0 if edited == text else exact(text, edited)))
        next_errors.append(r["near_next"] - (1.0 if after == text else exact(text, after)))
    for name, errors in (("edited", edited_errors), ("next", next_errors)):
        rms, most = float(np.sqrt(np.mean(np.square(errors)))), float(np.abs(errors).max())
        print(name, "rms", rms, "most", most)
        assert rms <= 0.02 and most <= 0.1
