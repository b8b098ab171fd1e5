import itertools
import random

import pytest

from inkveil.llm import simhash


def shingles(text, words=5):
    w = text.split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """Pairs of a similarity from 0.6 to 0.95, apart and in chains, against all pairs."""
    monkeypatch.setattr("inkveil.llm.buckets.BLOCK_ROWS", 64)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(text))
        for at in rng.sample(range(len(text)), max(1, round(len(text) * rng.uniform(0.005, 0.05)))):
            text[at] = rng.choice(words)
        texts.append(" ".join(text))
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(80):
        near = list(base)
        for at in rng.sample(range(150), rng.randint(1, 8)):
            near[at] = rng.choice(words)
        texts.append(" ".join(near))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    near = []
    for a, b in itertools.combinations(range(len(texts)), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        near.append(j)
        if j >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert sum(0.7 <= j < 0.8 for j in near) > 40 and sum(0.8 <= j < 0.9 for j in near) > 40
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(root)


@pytest.mark.parametrize("less, kept", [(8, 1), (9, 2)])
def test_the_limit_itself_links(spark, less, kept):
    """Texts of 40 and 40 - `less` shingles, the shorter one's all shared: 0.8 and 0.775."""
    words = [f"w{k}" for k in range(44)]
    rows = [(1, " ".join(words)), (2, " ".join(words[: 44 - less]))]
    assert simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == kept
