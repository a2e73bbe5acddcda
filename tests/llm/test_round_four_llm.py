from __future__ import annotations

from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np

from lexigrid.llm import lm_score, queries


def test_lm_trains_on_every_place(spark, sf):
    """Windows and the rest hold every id of every training text as a target; where windows don't overlap, once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    odd = spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "one two " * 5_000), (90_004, "a"), (90_004, "a")], "doc_id long, text string")
    vocabulary = spark.sparkContext.broadcast(lm_score.Vocabulary(Path(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")).read_bytes()))
    sub, end = lm_score.subwords_of(vocabulary.value), vocabulary.value.end
    for part in (docs.where(f"length(text) < {lm_score.WINDOW_CHARS}"), docs.unionByName(odd)):
        want, got = Counter(), Counter()
        for ids in sub.texts([lm_score.words_of(r["text"]) for r in part.collect()]):
            want.update(pairwise([end, *ids.tolist(), end]))
        for r in lm_score.gather(part, "doc_id", "text", vocabulary).where(f"kind in ({lm_score.PIECE}, {lm_score.REST})").collect():
            ids, ok = lm_score.windows_of([bytes(r["word"])[8:]])
            for x, y in zip(ids[:, :-1][ok].tolist(), ids[:, 1:][ok].tolist(), strict=True):
                got[x, y] += r["c"]
        assert not want - got
        assert got == want or part.where(f"length(text) >= {lm_score.WINDOW_CHARS}").count()


def test_lm_windows_of_rows():
    rows = [np.arange(n, dtype="<u2").tobytes() for n in (1, 2, 49, 50, 97, 98, 300)]
    ids, ok = lm_score.windows_of(rows)
    assert ids.shape == (1 + 1 + 1 + 2 + 2 + 3 + 7, lm_score.WINDOW + 1)
    assert ids[:, 1:][ok].tolist() == [k for n in (1, 2, 49, 50, 97, 98, 300) for k in range(1, n)]
    assert (ids[:, 1:][ok] == ids[:, :-1][ok] + 1).all()
