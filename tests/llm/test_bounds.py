"""Memory that doesn't follow the texts, packing that doesn't follow the splits, and how well the given labels are learnt."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F
from test_exact import brute_best_fit

from inkveil.llm import packing, toxicity
from inkveil.llm.queries import op2_toxicity


def field_of(rng):
    own = toxicity.Field(np.zeros(toxicity._SLOTS), np.array([[0.9, -1.1], [-0.7, 1.2]]), np.array([0.3, -0.4]), np.array([-1.0, 0.2, 0.4]))
    own.weights[: toxicity.WEIGHTS] = np.random.default_rng(rng).normal(-0.1, 0.5, toxicity.WEIGHTS)
    return own


def test_texts_scored_in_pieces_score_as_whole_ones(monkeypatch):
    rng = random.Random(3)
    texts = [(" " if k % 4 else "\n ").join(rng.choice(["a", "ΑΣ", "İx", "badword", "fine", "y" * 90]) + rng.choice(["", ".", "7"]) for _ in range(rng.choice([0, 1, 5, 300, 2000]))) for k in range(16)]
    texts += ["", "   \n ", " " * 500 + "a", "z" * 700, "a " * 200 + " " * 300]
    own = field_of(1)
    whole, spans = toxicity.score_texts(own, toxicity._Known(own), texts)
    assert any(spans) and whole.std() > 0.01
    for most in (37, 400, 5000):
        monkeypatch.setattr(toxicity, "SCORE_CHARS", most)
        cut, found = toxicity.score_texts(own, toxicity._Known(own), texts)
        assert np.allclose(cut, whole, atol=1e-9) and found == spans
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 3)
    assert np.allclose(toxicity.score_texts(own, toxicity._Known(own), texts)[0], whole, atol=1e-9)


def test_scoring_many_long_texts_takes_little_memory():
    rng = random.Random(5)
    own, words = field_of(2), [f"w{k}" for k in range(3000)]
    own.weights[toxicity._BIAS] = -9  # spans are part of the result: here are few
    long = " ".join(rng.choice(words) for _ in range(20_000))
    for texts in ([long] * 64, [" ".join([long] * 30)]):
        tracemalloc.start()
        toxicity.score_texts(own, toxicity._Known(own), texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 << 20


def test_given_labels_are_learnt(spark):
    """Held-out documents of the given tables: of pairs of a toxic and a clean text, how many are in order."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = op2_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    order = ((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2)
    hit = int(((rows.predicted == 1) & (rows.toxic == 1)).sum())
    print("held out", len(bad), len(good), "AUC", round(order, 3), "precision", hit, int(rows.predicted.sum()), "recall", hit, len(bad))
    assert order > 0.88 and hit >= 0.85 * rows.predicted.sum() and hit >= 0.7 * len(bad)


def items(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")


def test_packed_against_brute_force_and_other_splits(spark):
    rng = random.Random(8)
    rows = [(k if k % 9 else None, rng.choice([None, -3, 0, rng.randint(1, 250)]), rng.choice([None, "a", "b", f"s{k % 40}"]), rng.choice([None, k % 60])) for k in range(700)]
    rows += [(9999, 7, None, None)] * 150 + [(None, 30, "a", 4)] * 70
    capacity = 100
    pieces = []
    for doc, length, source, cluster in rows:
        n = max(length or 0, 0)
        for piece in range(max(1, -(-n // capacity))):
            pieces.append((doc, piece, min(n - piece * capacity, capacity), source, cluster))
    pieces.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1], x[3] is None, x[3] or "", x[4] is None, x[4] or 0))
    # Null sources and clusters conflict with nothing, so each is one of its own here.
    sources, clusters = ([x[k] if x[k] is not None else ("none", i) for i, x in enumerate(pieces)] for k in (3, 4))
    _, brute = brute_best_fit([x[2] for x in pieces], sources, clusters, capacity)
    out = packing.packed(items(spark, rows), capacity, group_items=10**6).toPandas()
    assert len(out) == len(pieces)
    assert out.groupby("bin").n_tokens.sum().sort_values().tolist() == sorted(np.bincount(brute, [x[2] for x in pieces]).astype(int).tolist())
    runs = [packing.packed(items(spark, rows).repartition(n, F.rand(n)), capacity, group_items=200) for n in (1, 7)]
    one, other = (sorted(map(str, r.collect())) for r in runs)
    assert one == other and len(one) == len(pieces)
