"""Near copies against the Jaccard similarity of all pairs, and the pipeline's stage."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from knotwork.llm import common, near_copies


def grams(text, words):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def alike(a, b, words=5, similarity=0.8):
    a, b = grams(a, words), grams(b, words)
    return len(a & b) >= similarity * len(a | b) - 1e-9


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = [None, "", " ", "one two", "One  two", "one two three four five six"]
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(5, 160))] + passage * (i % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # a chain of changes, so similarity is not transitive
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    base = [rng.choice(words) for _ in range(120)]
    texts += [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(100)]  # a large group
    return texts


@pytest.mark.parametrize(("words", "similarity", "small"), [(5, 0.8, False), (3, 0.6, False), (5, 0.8, True)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, words, similarity, small):
    texts = corpus(3, 60)
    if small:  # shards of many blocks, trees of many levels, hot keys
        monkeypatch.setattr(near_copies, "BLOCK", 7)
        monkeypatch.setattr(near_copies, "LEAF", 2)
        monkeypatch.setattr(near_copies, "TURNS", 1)
        monkeypatch.setattr(common, "HOT", 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(df, words=words, similarity=similarity).collect()}
    low = list(range(len(texts)))
    for _ in texts:
        before = list(low)
        for i, a in enumerate(texts):
            for j in range(i):
                if low[i] != low[j] and alike(a, texts[j], words, similarity):
                    low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    assert got == dict(enumerate(low))


def test_trees_find_all_within():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 24, 3000, dtype=np.uint64)
    tree = near_copies.Tree(values)
    for q in values[:40]:
        assert sorted(tree.within(q, 4)) == np.flatnonzero(np.bitwise_count(values ^ q) <= 4).tolist()
    assert near_copies.Tree(np.zeros(2000, np.uint64)).within(np.uint64(0), 0).tolist() == list(range(2000))


def test_sketches_against_sets():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 90), replace=False)) for _ in range(80)]
    low = near_copies.sketches(pa.array([s[: near_copies.SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())))
    sizes = np.array([len(s) for s in sets])
    share = 0.5 * near_copies.SKETCH - near_copies.DEVIATIONS * (0.25 * near_copies.SKETCH) ** 0.5
    for a, own, n in zip(sets, low, sizes, strict=True):
        got = near_copies.alike(own, n, low, sizes, 0.5)
        for b, g in zip(sets, got, strict=True):
            if max(len(a), len(b)) <= near_copies.SKETCH:
                assert g == (len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) - 1e-9)
            else:
                least = np.union1d(a, b)[: near_copies.SKETCH]
                seen = np.intersect1d(a[: near_copies.SKETCH], b[: near_copies.SKETCH])
                assert g == (len(np.intersect1d(least, seen)) >= share)


def test_stage_leaves_no_near_copies(spark, tmp_path):
    texts = corpus(4, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r["text"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, str(tmp_path)).collect()]
    assert not any(alike(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(alike(t, k) or t == k for k in kept) or any(t != u and alike(t, u) for u in texts) for t in texts)


@pytest.mark.parametrize("small", [False, True])
def test_rows_do_not_grow_with_pairs(spark, monkeypatch, small):
    """A group whose pairs mostly just miss the similarity, so that stars leave most members apart, makes no row for each pair."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = []
    for k in range(240):
        own = list(base)
        for at in rng.sample(range(120), 1 + k % 4):
            own[at] = f"x{k}_{at}"
        texts.append(" ".join(own))
    if small:  # clusters cut by members and by hashes, few looked up at once
        monkeypatch.setattr(near_copies, "BLOCK", 50)
        monkeypatch.setattr(near_copies, "HASHES", 3000)
        monkeypatch.setattr(near_copies, "LOOKED_UP", 1000)
    made, spool = {}, near_copies.spool

    def counted(df, name):
        out = spool(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "spool", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(df).collect()}
    links = [(i, j) for i, a in enumerate(texts) for j in range(i) if alike(a, texts[j])]
    low = list(range(len(texts)))
    for _ in texts:
        before = list(low)
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    assert got == dict(enumerate(low))
    assert 1 < len(set(low)) < len(texts)
    if not small:
        assert max(made.values()) <= len(texts) * near_copies.LOWEST, made


def test_forests_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[1:], rng.integers(1 << 62, 1 << 63, 15, dtype=np.uint64)])) for _ in range(40)]
    rows = [(k, len(s), int(np.uint64(near_copies.fingerprint(s)).view(np.int64)), k, [int(x) for x in s[: near_copies.SKETCH]], 1) for k, s in enumerate(sets)]

    def forest(rows):
        df = spark.createDataFrame(rows, "fp long, n int, print long, root long, low array<long>, h long").coalesce(1)
        return sorted(tuple(r) for r in near_copies._candidates(df, 0.7, len(rows)).collect())

    assert forest(rows) == forest(rows[::-1])
    assert len(forest(rows)) == len(rows) - 1
