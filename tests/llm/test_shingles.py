from __future__ import annotations

import random

import numpy as np

import corpus_pipeline as pipeline
from watchglass.llm import shingles, simhash


def test_pipeline_keeps_one_of_all_near_copies(spark):
    """Groups against all pairs, for texts whose fingerprints are more than three bits apart."""
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([60, 120, 200]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    texts += ["one two", "ONE  two", "one three", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, prints = [shingles.shingle_set(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    beyond = 0
    for i in range(len(texts)):
        for j in range(i):
            bits = ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count()
            near = len(sets[i]) and len(sets[j]) and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8
            beyond += bool(near and bits > 3)
            if near or bits <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert beyond > 5
    kept = pipeline.drop_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_no_texts_have_no_links(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert shingles.links(docs, shingles.prints(docs)).count() == 0


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(0)
    for n in (5, 60, 400, 3000):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        for m in (0, 1, n // 20, n // 10, n // 5, n // 2):
            b = np.unique(np.concatenate([a[m:], rng.integers(-(1 << 63), 1 << 63, m)]))
            differ = int(np.bitwise_count((shingles.sketch(a) ^ shingles.sketch(b)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(a, b))
            assert not shingles.similar(a, b) or 9 * differ <= len(a) + len(b)
            wide = shingles.differing(shingles.wide(a), shingles.wide(b))
            assert wide == shingles.differing(shingles.wide(b), shingles.wide(a)) <= len(np.setxor1d(a, b))
            assert (m < n // 2 or n < 60) or 9 * wide > len(a) + len(b)
