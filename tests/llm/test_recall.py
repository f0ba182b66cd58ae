"""Near duplicates at the edge: single pairs whose similarity is just over the least."""

from __future__ import annotations

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import texts as plain  # noqa: E402

from reviewflow.llm import near_dups  # noqa: E402


def test_pairs_just_over_the_least_similarity_are_found(spark):
    rng = np.random.default_rng(14)
    rows, wanted, apart = [], [], []
    while len(wanted) < 400 or len(apart) < 100:
        words = [f"w{k}" for k in rng.integers(0, 1 << 40, int(rng.integers(60, 200)))]
        edited = list(words)
        for at in rng.integers(0, len(words), int(rng.integers(1, 6))):
            edited[at] = f"e{rng.integers(0, 1 << 40)}"
        a, b = " ".join(words), " ".join(edited)
        similarity = plain.similarity(plain.bag(a), plain.bag(b))
        chosen = wanted if 0.8 <= similarity <= 0.84 else apart if 0.7 < similarity < 0.8 else None
        if chosen is not None:
            chosen.append(len(rows))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    group = {r.doc_id: r.class_id for r in found.collect()}
    assert sum(group[i] == group[i + 1] for i in wanted) >= 0.995 * len(wanted)
    assert not any(group[i] == group[i + 1] for i in apart)
