"""The pipeline's near-dedup finds candidates by SimHash with generalised pigeonhole partitions."""

import random

import numpy as np

import corpus_pipeline as p
from tallyweave.llm import simhash


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """With bands that no two texts share, near copies are still one group, and unlike texts stay."""
    monkeypatch.setattr(simhash, "marked_texts", (lambda made: lambda docs, shingle, bands: made(docs, shingle, 0))(simhash.marked_texts))
    rng = random.Random(5)
    rows = []
    for g in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(4):
            copy = list(words)
            if k:
                copy[rng.randrange(400)] = f"x{g}{k}"
            rows.append((4 * g + k, " ".join(copy), "s"))
    left = p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    prints = [simhash.fingerprint(np.unique(np.array(simhash.shingle_hashes(t, 5), np.uint64))) for _, t, _ in rows]
    near = {i for i in range(80) if i % 4 and any((prints[i] ^ prints[j]).bit_count() <= simhash.CANDIDATE_BITS for j in range(i - i % 4, i))}
    assert len(near) == 60 and sorted(r["doc_id"] for r in left) == [4 * g for g in range(20)]
