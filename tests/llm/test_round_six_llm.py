"""Findings of the fourth round on training-data operators, each by a case that failed before."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

import numpy as np

from lexigrid.llm import near_dedup
from lexigrid.session import shared_folder


def test_near_dedup_takes_slices_and_leaves_no_files(spark, monkeypatch):
    """Lists, pairs and look-ups in many slices give the groups of brute force; nothing that was written for them stays."""
    rng = np.random.default_rng(8)
    texts = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(90)]
        for _ in range(1 + g % 5):
            texts.append(list(words))
            words[int(rng.integers(90))] = f"x{rng.integers(10**9)}"
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    for name, most in (("SLICE_ROWS", 150), ("SLICE_INTS", 150), ("BROADCAST_ROWS", 8)):
        monkeypatch.setattr(near_dedup, name, most)
    folder = Path(urlparse(shared_folder(spark)).path)
    scratch = lambda: {p.name for p in folder.iterdir() if p.name[32:33] == "-" and p.name[33:] in ("docs", "once", "counted", "lists", "open", "sets")}
    before, read = scratch(), []
    slice_of = near_dedup.slice_of
    monkeypatch.setattr(near_dedup, "slice_of", lambda rows, k, of, *key: read.append((key, of)) or slice_of(rows, k, of, *key))
    got = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect())
    assert got == [k for k, g in enumerate(group) if k == g] and len(got) < len(texts)
    assert {key for key, of in read if of > 1} >= {("s",), ("fp",), ("h",)}
    assert scratch() == before
