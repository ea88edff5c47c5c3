"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word left out of a whole text, each
hashed to 64 bits.  FTRL-proximal keeps a learning rate per coordinate, and its L1 term leaves a few
hundred weights, which are broadcast.  Learning takes at most ``sample`` labelled rows, those with
the smallest hash of their identifier, and of these as many as have ``SAMPLE_BYTES`` of text together
(at least one); one task learns from them row by row, so the driver gets the weights only.  Features of
a single sampled row teach nothing and are left out, and of the weights the ``MAX_WEIGHTS`` largest stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, indexed, pick, release, worker_cache

#: Labelled rows to learn from at most.
SAMPLE = 12_000
#: Bytes of text to learn from at most: one task holds some ten times as much.
SAMPLE_BYTES = 48 << 20
#: Weights to broadcast at most (the largest stay): 16 bytes each.
MAX_WEIGHTS = 1 << 18
#: Bytes of words and hashes that a worker remembers, about.
CACHE = 32 << 20
_FILTER_BITS = 20
_COUNT_BITS = 24
#: Features in one row on the way to the learning task, so that batches of rows stay small.
_PART = 256
_PAIR, _NEXT, _SKIP, _AFTER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """The distinct 64-bit feature hashes of a whole text, sorted."""
    words = _WORD.findall((text or "").lower())
    known = worker_cache("toxicity", lambda: Remembered(CACHE))
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            known.put(w, h)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    return np.unique(np.concatenate([h, h[:-1] * _PAIR + h[1:] * _NEXT, h[:-2] * _SKIP + h[2:] * _AFTER]))


@dataclass(frozen=True)
class Model:
    """bias and the non-zero weights by feature hash (sorted)."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        """A bitmap over the hashes' low bits: most features are ruled out by one read."""
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(self.keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return seen

    def score(self, found: np.ndarray, seen: np.ndarray) -> float:
        found = found[seen[(found & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]]
        total = self.bias
        if len(found) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            total += float(self.weights[at][self.keys[at] == found].sum())
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, total))))


def ftrl(
    rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = 4
) -> Model:
    """FTRL-proximal over (feature hashes, label) rows in their order; the bias has no L1 term."""
    if not rows:
        return Model(-2.0, np.zeros(0, np.uint64), np.zeros(0))
    # A feature of one row alone cannot pass the L1 term in a useful way and is left out; most go by a
    # table of counts by hash bits before the exact count, which saves memory.
    low = np.uint64((1 << _COUNT_BITS) - 1)
    seen = np.zeros(1 << _COUNT_BITS, np.uint8)
    for f, _ in rows:
        bits = (f & low).astype(np.int64)
        seen[bits] = np.minimum(seen[bits] + 1, 2)
    rows = [(f[seen[(f & low).astype(np.int64)] > 1], y) for f, y in rows]
    keys, times = np.unique(np.concatenate([f for f, _ in rows]), return_counts=True)
    keys = keys[times > 1]
    own = []
    for f, y in rows:
        at = np.searchsorted(keys, f)
        at = at[at < len(keys)]
        own.append((at[keys[at] == f[: len(at)]].astype(np.int32), y))
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    zb = nb = 0.0
    for _ in range(epochs):
        for at, y in own:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, b + float(w.sum()))))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] = ni + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.nonzero(w)[0]
    if len(kept) > MAX_WEIGHTS:
        kept = np.sort(kept[np.argsort(-np.abs(w[kept]), kind="stable")[:MAX_WEIGHTS]])
    return Model(-zb / ((beta + math.sqrt(nb)) / alpha), keys[kept], w[kept])


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    """Whether crc32 of the identifier as text is divisible by 5; a null one counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled rows that are not held out.

    Rows with a null identifier or label play no part; if an identifier has several labels, the
    largest counts, and rows that share an identifier are learned as one.  Without any usable row the model scores every text alike.
    """
    known = pick(labels, id=id_col, y=label_col).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, y, t in zip(b["o"], b["y"], b["text"], strict=True):
                f = features(t.as_py()).view(np.int64)
                parts = [f[at : at + _PART] for at in range(0, max(1, len(f)), _PART)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([o.as_py()] * n, pa.int64()), pa.array([y.as_py()] * n, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], ["o", "y", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            for o, y, f in zip(b["o"].to_pylist(), b["y"].to_pylist(), b["f"], strict=True):
                parts.setdefault((o, int(y > 0)), []).append(f.values.to_numpy().view(np.uint64).copy())
        m = ftrl([(np.unique(np.concatenate(parts.pop(key))), key[1]) for key in sorted(parts)])
        yield pa.RecordBatch.from_arrays([pa.array([None, *m.keys.view(np.int64).tolist()], pa.int64()), pa.array([m.bias, *m.weights.tolist()], pa.float64())], ["k", "w"])
        release()

    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("o"), F.col("y").cast("long").alias("y"), "text")
    sizes = rows.groupBy("o").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))  # one row for each sampled identifier
    sizes = sizes.withColumn("before", F.sum("size").over(Window.orderBy("o")) - F.col("size"))
    rows = rows.join(F.broadcast(sizes.filter(F.col("before") <= F.lit(limit) - F.col("size")).select("o").unionByName(sizes.filter("before = 0").select("o")).distinct()), "o", "left_semi").select("o", "y", "text")
    got = rows.mapInArrow(found, "o long, y long, f array<long>").repartition(1).mapInArrow(learn, "k long, w double").collect()
    bias = next((r["w"] for r in got if r["k"] is None), -2.0)
    pairs = sorted((r["k"] & 0xFFFFFFFFFFFFFFFF, r["w"]) for r in got if r["k"] is not None)
    return Model(bias, np.array([k for k, _ in pairs], np.uint64), np.array([w for _, w in pairs]))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """The rows with the score of their whole text behind their own columns; null counts as empty."""
    names = docs.columns
    frame = indexed(docs)
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = cache.setdefault("seen", m.lookup())
        for b in batches:
            scores = pa.array([m.score(features(t.as_py()), seen) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, "__score"])
        release()

    schema = T.StructType([*frame.schema.fields, T.StructField("__score", T.DoubleType())])
    return frame.mapInArrow(run, schema).toDF(*names, column)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    A null text counts as empty, and empty ones score what the bias says.  Repeated rows each get a
    row; an empty table gives an empty result; without labels all score alike; other columns play no
    part, whatever their names.
    """
    model = train(docs, labels, sample)
    rows = with_score(pick(docs, doc_id="doc_id", text="text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
