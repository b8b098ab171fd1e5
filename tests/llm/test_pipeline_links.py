import itertools
import random

import corpus_pipeline
from inkveil.llm import simhash


def shingles(text, words=5):
    w = text.split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}


def test_the_pipeline_links_what_operator_3_links(spark):
    """Texts whose fingerprints are near though their sets of shingles aren't, and the reverse, against all pairs."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(12):
        # A refrain of many repeats decides the fingerprint; sets of shingles count it once.
        refrain = " ".join(rng.choice(words) for _ in range(4 + k % 3))
        for n in (0, 20, 40):
            texts.append(" ".join([refrain] * 60 + [rng.choice(words) for _ in range(n)]))
    for _ in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(80, 200))]
        texts.append(" ".join(text))
        for at in rng.sample(range(len(text)), 2):
            text[at] = rng.choice(words)
        texts.append(" ".join(text))
    texts += ["", "  ", "one"]
    sets, prints, root = [shingles(t) for t in texts], [int.from_bytes(simhash.fingerprint(t, 3), "little") for t in texts], list(range(len(texts)))
    both = [0, 0, 0]
    for a, b in itertools.combinations(range(len(texts)), 2):
        near, alike = (prints[a] ^ prints[b]).bit_count() <= 2, len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
        both = [both[0] + (near and not alike and prints[a] != prints[b]), both[1] + (near and not alike), both[2] + (alike and not near)]
        if (near or alike) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    print("near, not alike, not equal; near, not alike; alike, not near:", both)
    assert both[1] > 10 and both[2] > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(root)
