"""Where two encoders' sequences differ: the places of a shortest difference, in linear space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = "array<struct<a_start:long,a_end:long,b_start:long,b_end:long>>"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items are the same."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


#: Edits that are first allowed for; four times as many each time that they don't do.
EDITS = 64


def _lengths(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Length of a longest common subsequence of all of ``a`` and each beginning of ``b``; one row is held.

    Only places that so many edits can reach are filled in: lengths are never too great, and right where no more are needed.
    """
    row = np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - edits), min(len(b), i + edits)
        if lo > hi:
            break
        own = row[lo - 1 : hi + 1]
        own[1:] = np.maximum(own[1:], own[:-1] + (b[lo - 1 : hi] == x))
        np.maximum.accumulate(own, out=own)
    np.maximum.accumulate(row, out=row)
    return row


def _inside(a: np.ndarray, b: np.ndarray) -> list[int] | None:
    """Places of ``a`` that hold the items of ``b`` in order, none if ``a`` does not hold all of them."""
    places, items = [], enumerate(a.tolist())
    for y in b.tolist():
        for k, x in items:
            if x == y:
                places.append(k)
                break
        else:
            return None
    return places


def differences(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(a_start, a_end, b_start, b_end) of each place where the sequences differ; outside of them they are the same.

    What lies outside is a longest common subsequence. The halves of ``a`` are matched with the two parts of ``b`` whose
    common subsequences are longest together, and so on for each half; a row of ``b`` is all that is kept at a time.
    Where one part only leaves items of the other out, the items left out are the shortest difference: one look finds them.
    Elsewhere time is in proportion to the length times the number of differing items.
    """
    found: list[tuple[int, int, int, int]] = []
    stack = [(0, len(a), 0, len(b), 0)]
    while stack:
        i, j, k, m, edits = stack.pop()
        head = _common(a[i:j], b[k:m])
        i, k = i + head, k + head
        tail = _common(a[i:j][::-1], b[k:m][::-1])
        j, m = j - tail, m - tail
        if i == j and k == m:
            continue
        if i == j or k == m or (j - i == 1 and not (b[k:m] == a[i]).any()) or (m - k == 1 and not (a[i:j] == b[k]).any()):
            found.append((i, j, k, m))
            continue
        if j - i == 1:
            at = k + int(np.flatnonzero(b[k:m] == a[i])[0])
            found += [(i, i, k, at)] * (at > k) + [(j, j, at + 1, m)] * (at + 1 < m)
            continue
        longer, shorter = (a[i:j], b[k:m]) if j - i >= m - k else (b[k:m], a[i:j])
        if (at := _inside(longer, shorter)) is not None:
            at = np.array([-1, *at, len(longer)])
            for n in np.flatnonzero(np.diff(at) > 1).tolist():
                gap = int(at[n]) + 1, int(at[n + 1])
                found.append((i + gap[0], i + gap[1], k + n, k + n) if j - i >= m - k else (i + n, i + n, k + gap[0], k + gap[1]))
            continue
        mid = (i + j) // 2
        known, edits = edits > 0, edits or EDITS  # what a whole needs is enough for its parts
        while True:
            both = _lengths(a[i:mid], b[k:m], edits) + _lengths(a[mid:j][::-1], b[k:m][::-1], edits)[::-1]
            needed = j - i + m - k - 2 * int(both.max())  # at least what is truly needed
            if known or needed <= edits:
                break
            edits = min(4 * edits, needed)
        cut = k + int(np.argmax(both))
        stack += [(mid, j, cut, m, edits), (i, mid, k, cut, edits)]
    out: list[tuple[int, int, int, int]] = []
    for p in sorted(found):
        if out and out[-1][1] == p[0] and out[-1][3] == p[2]:
            out[-1] = (out[-1][0], p[1], out[-1][2], p[3])
        else:
            out.append(p)
    return out


def sequence_differences(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n_a, n_b, first, mismatches, same, places) of two array columns of each row.

    ``first`` is the first place, from 0, at which the sequences do not have the same item, null if they are equal;
    ``mismatches`` counts such places, one sequence's end against the other's rest too; ``same`` and ``places`` are
    those of a shortest difference, so that one item more does not shift all that follows. Null items equal each other and
    null arrays are empty. Rows stay as they are, repeated ones too; an empty table gives an empty one.
    """
    own = df.select(*by, F.coalesce(F.col(a), F.array()).alias("__a"), F.coalesce(F.col(b), F.array()).alias("__b"))
    kinds = [(c, own.schema[c].dataType.simpleString()) for c in by]
    columns = ("n_a", "n_b", "first", "mismatches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, places, counted = [], [], []
            sides = batch.column("__a"), batch.column("__b")
            # items are numbered by Arrow, over the batch
            ids = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([pc.list_value_length(s).to_numpy(zero_copy_only=False) for s in sides]).astype(np.int64)).tolist()
            parts = [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            for x, y in zip(parts[: batch.num_rows], parts[batch.num_rows :], strict=True):
                both = min(len(x), len(y))
                unlike = np.flatnonzero(x[:both] != y[:both])
                first = int(unlike[0]) if len(unlike) else both if len(x) != len(y) else None
                counted.append((len(x), len(y), first, len(unlike) + abs(len(x) - len(y))))
                found = differences(x, y)
                same.append(len(x) - sum(j - i for i, j, _, _ in found))
                places.append([dict(zip(("a_start", "a_end", "b_start", "b_end"), p, strict=True)) for p in found])
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("a_start", "a_end", "b_start", "b_end")]))
            numbers = [pa.array(c, pa.int32()) for c in zip(*counted, strict=True)] or [pa.array([], pa.int32())] * len(columns)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c, _ in kinds], *numbers, pa.array(same, pa.int64()), pa.array(places, kind)], names=[*[c for c, _ in kinds], *columns, "same", "places"])

    return own.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in [*kinds, *((c, "int") for c in columns)]) + f", same long, places {PLACES}")
