"""All-pairs neighbours against brute force."""

import numpy as np
import pytest

from knotwork.operators import vector


def brute(q, x, own, k, metric):
    if metric == "euclidean":
        s = 1 - np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T))
    else:
        s = q @ x.T
        if metric == "cosine":
            n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
            s = np.divide(s, n, out=np.zeros_like(s), where=n != 0)
    s = np.round(s, 12)
    s[np.arange(len(q))[own >= 0], own[own >= 0]] = -np.inf
    i = np.argsort(-s, 1, kind="stable")[:, :k]
    return np.where(np.isfinite(np.take_along_axis(s, i, 1)), i, -1)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("kind", ["any", "ties", "equal", "rising"])
def test_best_of_each_row(monkeypatch, metric, kind):
    monkeypatch.setattr(vector, "ROWS", 7)
    monkeypatch.setattr(vector, "COLUMNS", 13)
    draw = np.random.default_rng(3)
    for m, k in ((1, 2), (40, 1), (120, 3), (121, 5)):
        x = draw.standard_normal((m, 6)) if kind in ("any", "rising") else draw.integers(-1, 2, (m, 6)).astype(float)
        x = np.repeat(x[:1], m, 0) if kind == "equal" else x[np.argsort(x[:, 0])] if kind == "rising" else x
        q = np.concatenate([x, draw.standard_normal((9, 6)), np.zeros((1, 6))])
        own = np.concatenate([np.arange(m), np.full(10, -1)])
        want = brute(q, x, own, k, metric)
        want = np.pad(want, ((0, 0), (0, k - want.shape[1])), constant_values=-1)
        assert (vector._best(q, x, own, k, metric)[1] == want).all()


def test_few_measures_are_sorted(monkeypatch):
    """Only what may be among the nearest is sorted, not every row of measures."""
    seen = []
    monkeypatch.setattr(vector.np, "lexsort", lambda keys, f=np.lexsort: seen.append(len(keys[0])) or f(keys))
    x = np.random.default_rng(5).standard_normal((9000, 8))
    vector._best(x[:512], x, np.arange(512), 3, "cosine")
    assert sum(seen) < 512 * 9000 / 100


def test_blocks_and_chunks_give_the_same(spark, monkeypatch):
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.standard_normal((150, 4)), np.repeat(draw.standard_normal((1, 4)), 30, 0)]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 4)], "id long, x array<float>")
    want = brute(x[:60], x, np.arange(60), 3, "cosine")
    for numbers, least in ((2**22, 4096), (200, 10)):
        monkeypatch.setattr(vector, "NUMBERS", numbers)
        monkeypatch.setattr(vector, "LEAST", least)
        got = {(r.id, r.n): r.other for r in vector.neighbors(df.where("id < 60 OR id = 500"), df, 3).collect()}
        assert got == {(i, n + 1): int(o) for i, row in enumerate(want) for n, o in enumerate(row)}
