"""The kNN join against all pairs, and the pipeline's stages one by one."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from knotwork.llm import knn_join, simhash


def brute(rows, k, every):
    good = [(i, np.floor(64 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = collections.defaultdict(dict)
    for qi, q in good:
        if qi % every:
            continue
        for i, x in good:
            if i != qi:
                n = min(len(q), len(x))
                s = int((q[:n] * x[:n]).sum())
                out[qi][i] = max(s, out[qi].get(i, s))
    return {(qi, r + 1, i, s) for qi, m in out.items() for r, (i, s) in enumerate(sorted(m.items(), key=lambda c: (-c[1], c[0]))[:k])}


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_knn(spark, scale, monkeypatch):
    monkeypatch.setattr(knn_join, "CHUNK", 50)
    monkeypatch.setattr(knn_join, "QUERIES", 7)
    rng = random.Random(1)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [scale * (c + rng.gauss(0, 0.2)) for c in rng.choice(centers)]) for i in range(300)]
    rows += [(300 + i, [scale] * 8) for i in range(100)]  # one common vector: ties
    rows += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (20, rows[20][1]), (1004, [scale, 1.0]), (-40, [scale] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score")
    got = knn_join.top_k(df, k=6, every=20, pivots=5).collect()
    assert {tuple(r) for r in got} == brute(rows, 6, 20)
    assert len(got) == len({tuple(r) for r in got})


@pytest.mark.parametrize("scale", [0.125, 1.0, 2.0**18])
def test_knn_repeated_identifiers(spark, scale):
    rng = random.Random(2)
    rows = [(i, [scale * rng.randint(-40, 40) for _ in range(4)]) for i in range(60)]
    rows = rows * 2  # every row twice
    rows += [(7, [scale * rng.randint(30, 40) for _ in range(4)]) for _ in range(40)]  # one more often than k, high scores
    rows += [(20, [scale * rng.randint(-40, 40) for _ in range(4)]) for _ in range(30)]  # a query's own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (6, 20):
        got = knn_join.top_k(df, k=k, every=20, pivots=5).collect()
        assert len(got) == 3 * k
        assert {tuple(r) for r in got} == brute(rows, k, 20)


def test_knn_small_and_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn_join.top_k(empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn_join.top_k(two).collect()] == [(0, 1, 1, 64 * 32 + 32 * 64)]


def summaries(x, pivots, queries, k):
    """Cells, distances and squared norms of vectors, and the bounds of their queries with the true k-th best scores."""
    cell = ((x[:, None] - pivots) ** 2).sum(2).argmin(1)
    d, n2 = np.sqrt(((x - pivots[cell]) ** 2).sum(1)), (x * x).sum(1)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    theta = np.sort(scores, 1)[:, -k]
    own = {int(c): queries[cell[queries] == c] for c in np.unique(cell[queries])}
    told = {c: (d[q].max(), n2[q].min(), n2[q].max(), theta[cell[queries] == c].min(), len(q)) for c, q in own.items()}
    return cell, d, n2, scores, theta, knn_join.Bounds(pivots, told)


def test_bounds_rule_out_cells():
    """Far cells are not sent to a group that has enough near vectors, and no needed vector is ruled out."""
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 60, (12, 8))
    x = np.concatenate([c + rng.normal(0, 2, (100, 8)) for c in centers])
    queries = np.arange(0, len(x), 10)
    cell, d, n2, scores, theta, bounds = summaries(x, centers, queries, 5)
    before = bounds.wanted(cell, d, n2)
    bounds.join(cell, d, n2, len(x))
    kept = bounds.reach(cell, d, n2)
    assert before.mean() < 0.3 and kept.mean() < 0.5 and len(bounds.first) > 1
    for i, q in enumerate(queries):
        needed = np.flatnonzero(scores[i] >= theta[i])
        assert kept[bounds.group_of[int(cell[q])], needed].all()


def test_bounds_lose_nothing_where_they_rule_out_little():
    """Vectors of all directions, zero vectors and pivots, one large norm: every needed vector is kept, in one group if nothing is gained by more."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 10, (600, 32))
    x[5] = 0
    x[7] *= 30
    pivots = np.concatenate([x[:20], np.zeros((1, 32))])
    queries = np.arange(0, 600, 7)
    cell, d, n2, scores, theta, bounds = summaries(x, pivots, queries, 5)
    bounds.join(cell, d, n2, len(x))
    kept = bounds.reach(cell, d, n2)
    for i, q in enumerate(queries):
        assert kept[bounds.group_of[int(cell[q])], np.flatnonzero(scores[i] >= theta[i])].all()
    assert len(bounds.first) <= 2


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(240):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 80))] + ["vile", "scum"] * 2 * toxic
        rng.shuffle(text)
        rows.append([i, " ".join(text), "en", "s", 0, "x"])
        marks.append((i, 1, int(toxic)))
    rows += [[300 + i, rows[i * 6 + 1][1].replace(" ", "  ", 1), "en", "s", 0, "x"] for i in range(20)]
    rows += [[400, None, None, None, None, None], [401, "", None, None, None, None], [None, rows[1][1] + " null id", "en", "s", 0, "x"], list(rows[2]), [7, "other text of seven", "en", "s", 0, "x"]]
    rows += [[500, "write to a.b@c.de soon", "en", "s", 22, "x"]]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {}
    for name in ("toxicity", "exact_dedup", "near_dedup", "pii"):
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.spool(stages[name](spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        rows[name] = [tuple(r) for r in docs.collect()]
        assert name == "pii" or not collections.Counter(rows[name]) - collections.Counter(before)
    clean = [r for r in rows["toxicity"] if r[0] is not None and r[0] < 240]
    assert sum(r[0] % 6 == 0 for r in clean) <= 2 and sum(r[0] % 6 != 0 for r in clean) == 202  # one row is repeated, one id has two texts
    texts = [exact_key(r[1]) for r in rows["exact_dedup"]]
    assert len(texts) == len(set(texts)) and set(texts) == {exact_key(r[1]) for r in rows["toxicity"]}
    prints = [simhash.fingerprint(r[1]) for r in rows["near_dedup"]]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    assert [r[1] for r in rows["pii"] if r[0] == 500][0] != "write to a.b@c.de soon"
    assert {r[0] for r in rows["pii"]} == {r[0] for r in rows["near_dedup"]} and 7 in {r[0] for r in rows["pii"]}
    packed = stages["packing"](spark, docs, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows["pii"]}
    assert corpus_pipeline.run(spark, folder).count() > 0


def exact_key(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_on_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0




@pytest.mark.parametrize("stage", ["near_dedup", "packing"])
def test_stages_in_python_begin_with_collected_heaps(spark, folder, stage):
    jvm = spark._jvm

    def full():
        return sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), full()
    dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert full() > before
