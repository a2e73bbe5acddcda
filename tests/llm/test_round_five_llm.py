from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest

from lexigrid.llm import lm_score


def some_net(scale: float) -> tuple[lm_score.Attention, np.random.Generator]:
    r, n = np.random.default_rng(5), lm_score.CLASSES
    pairs = lm_score.Pairs.from_counts(r.integers(0, 9, (n, n)) * (r.random((n, n)) < 0.05), r.integers(0, 50, n), r.integers(0, 50, n), np.full(n, 1 / n))
    return lm_score.Attention(r.normal(0, scale, lm_score.Attention.SIZE).astype(np.float32), pairs), r


def plain_loss(flat: np.ndarray, pairs: lm_score.Pairs, x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> float:
    """Mean negative log likelihood where ok, by the definition of the model."""
    net = lm_score.Attention(flat, pairs)
    logs = lambda z: z - np.logaddexp.reduce(z, axis=-1, keepdims=True)
    e = net.emb[x] + net.pos
    s = (e @ net.q) @ (e @ net.k).transpose(0, 2, 1) / math.sqrt(lm_score.WIDTH)
    h = e + np.exp(logs(np.where(net.SEEN > 0, s, -1e9))) @ (e @ net.v) @ net.o
    last = h + np.maximum(h @ net.a, 0) @ net.b
    group, member = np.divmod(y, lm_score.MEMBERS)
    of_group = logs(last @ net.top + net.top_bias + pairs.top[x])
    inside = logs(np.einsum("btw,btwm->btm", last, net.out[group]) + net.bias[group] + pairs.inside[x, group])
    at = lambda p, k: np.take_along_axis(p, k[..., None], axis=-1)[..., 0]
    return -float((at(of_group, group) + at(inside, member))[ok].mean())


@pytest.mark.parametrize("scale", [0.2, 0.7])
def test_lm_gradient_of_each_parameter(scale):
    """Against differences of the plain loss, also where logits are large and where an earlier call has left its numbers."""
    net, r = some_net(scale)
    x = r.integers(0, lm_score.CLASSES, (8, lm_score.WINDOW + 1))
    x[:, 30:] %= 40  # some groups have many rows, others none
    ok = r.random((8, lm_score.WINDOW)) < 0.8
    net.gradient(x[4:, :-1], x[4:, 1:], ok[4:])
    net.gradient(x[4:, 1:], x[4:, :-1], ok[4:])
    x, ok = x[:4], ok[:4]
    got = lm_score.Attention(net.gradient(x[:, :-1], x[:, 1:], ok).astype(float), net.pairs)
    for name, shape in lm_score.Attention.SHAPES:
        way = lm_score.Attention(np.zeros(lm_score.Attention.SIZE), net.pairs)
        getattr(way, name)[:] = r.normal(0, 1, shape)
        loss = lambda t, way=way: plain_loss(net.flat.astype(float) + t * way.flat, net.pairs, x[:, :-1], x[:, 1:], ok)
        assert (loss(1e-6) - loss(-1e-6)) / 2e-6 == pytest.approx(float(got.flat @ way.flat), rel=2e-3, abs=2e-3), name


def test_lm_step_works_in_its_own_room():
    net, r = some_net(0.2)
    x = r.integers(0, lm_score.CLASSES, (lm_score.STEP_WINDOWS, lm_score.WINDOW + 1))
    ok = np.ones((lm_score.STEP_WINDOWS, lm_score.WINDOW), bool)
    net.gradient(x[:, :-1], x[:, 1:], ok)
    tracemalloc.start()
    net.gradient(x[:, :-1], x[:, 1:], ok)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
