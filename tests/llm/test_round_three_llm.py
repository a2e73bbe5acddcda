"""Findings of the third round on the training-data operators."""

from __future__ import annotations

import numpy as np
import pytest

from lexigrid.llm import near_dedup, simhash


def test_near_dedup_asks_simhash_trees_first(spark, monkeypatch):
    """Pairs that SimHash links are compared, and only those of the similarity are dropped."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    texts = [words, [*words[:399], "other"], [f"v{k}" for k in range(50)], [f"v{k}" for k in rng.permutation(50)]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *a: asked.append(prints.count()) or links(prints, *a))
    monkeypatch.setattr(near_dedup, "central_pairs", lambda lists, _: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(near_dedup, "open_pairs", lambda lists, *_: spark.createDataFrame([], "a long, b long"))
    kept = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect())
    assert asked and kept == [0, 2, 3]


def test_simhash_bits_are_those_of_more_than_half():
    sets = np.array([0b0111, 0b0011, 0b0001, -1], np.int64)
    assert near_dedup.simhash_of(sets) == 0b0011
    assert near_dedup.simhash_of(np.array([-5], np.int64)) == -5
