"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes.  A gated recurrent unit runs over each window forwards, another
backwards; both states of a position give it a probability for every language, and a document's
probabilities are the mean over all its positions.  The network learns in numpy by backpropagation
through time, with a label at every position, from windows of at most ``SAMPLE`` documents a language.
Its weights are a few kilobytes whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

WINDOW = 128
HIDDEN = 12
#: Documents a language to learn from, windows of each, their characters; documents in all.
SAMPLE = 400
WINDOWS_EACH = 3
CHARS = 96
SAMPLE_ALL = 8_000
#: Documents of a language that are expected in the sample at least, however many languages there are.
LEAST = 20
STEPS = 300
BATCH = 128
TRAIN_LENGTH = 64
#: Windows that run at once.
BLOCK = 2048
UNDETERMINED = "und"


@dataclass
class Network:
    """For each direction input weights e (3H, 256), recurrent weights u (3H, H), bias c (H); v, b: output."""

    languages: list[str]
    e: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    v: np.ndarray
    b: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        h3 = 3 * hidden

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            languages,
            [normal(h3, 256, scale=0.3) for _ in range(2)],
            [normal(h3, hidden, scale=hidden**-0.5) for _ in range(2)],
            [np.zeros(hidden, np.float32) for _ in range(2)],
            normal(len(languages), 2 * hidden, scale=0.3),
            np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.e, *self.u, *self.c, self.v, self.b]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _states(x: np.ndarray, lengths: np.ndarray, e: np.ndarray, u: np.ndarray, c: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """The state after each position, (T, H, N), of windows x (T, N); ``keep`` gets what learning needs."""
    steps, n = x.shape
    hidden = u.shape[1]
    out = np.empty((steps, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    c = c[:, None]
    full = bool((lengths == steps).all())
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g = np.take(e, x[t], axis=1, mode="clip")
        a = u @ h
        g[: 2 * hidden] += a[: 2 * hidden]
        gates = _sigmoid(g[: 2 * hidden])
        z, r = gates[:hidden], gates[hidden:]
        a_n = a[2 * hidden :]
        a_n += c
        new = g[2 * hidden :]
        new += r * a_n
        np.tanh(new, out=new)
        before = h
        h = out[t]
        np.subtract(before, new, out=h)
        h *= z
        h += new
        if not full and back:
            h *= t < lengths
        if keep is not None:
            keep.append((t, z, r, new, a_n, before))
    return out


def position_probabilities(net: Network, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(T, C, N) probabilities of windows x (T, N)."""
    hidden = net.u[0].shape[1]
    y = net.v[:, :hidden] @ _states(x, lengths, net.e[0], net.u[0], net.c[0], False)
    y += net.v[:, hidden:] @ _states(x, lengths, net.e[1], net.u[1], net.c[1], True)
    y += net.b[:, None]
    y -= y.max(1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(1, keepdims=True)
    return y


def _gradients(net: Network, x: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross-entropy over all positions, in the order of ``weights()``; the loss."""
    steps, n = x.shape
    hidden = net.u[0].shape[1]
    lengths = np.full(n, steps)
    kept: list[list] = [[], []]
    states = [_states(x, lengths, net.e[d], net.u[d], net.c[d], bool(d), kept[d]) for d in range(2)]
    y = net.v[:, :hidden] @ states[0] + net.v[:, hidden:] @ states[1] + net.b[:, None]
    y -= y.max(1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(1, keepdims=True)
    loss = -float(np.log(np.maximum(y[:, labels, np.arange(n)], 1e-9)).mean())
    y[:, labels, np.arange(n)] -= 1
    y /= steps * n
    dv = np.concatenate([np.einsum("tcn,thn->ch", y, s, optimize=True) for s in states], 1)
    de, du, dc = [], [], []
    for d in range(2):
        up = np.einsum("ch,tcn->thn", net.v[:, d * hidden : (d + 1) * hidden], y, optimize=True)
        u = net.u[d]
        ge, gu, gc = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(u), np.zeros(hidden, np.float32)
        dh = np.zeros((hidden, n), np.float32)
        for t, z, r, new, a_n, before in reversed(kept[d]):
            dh = dh + up[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * a_n * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r])
            gc += da[2 * hidden :].sum(1)
            gu += da @ before.T
            np.add.at(ge, x[t], np.concatenate([dz, dr, dn]).T)
            dh = dh * z + u.T @ da
        de.append(ge.T)
        du.append(gu)
        dc.append(gc)
    return [*de, *du, *dc, dv, y.sum((0, 2))], loss


def learn(windows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, length: int = TRAIN_LENGTH, rate: float = 0.02) -> Network:
    """Learn from (bytes, language) windows with Adam; each batch has as many windows of every language."""
    languages = sorted({lang for _, lang in windows})
    net = Network.new(languages, hidden)
    by = [[np.frombuffer(b * (length // len(b) + 1), np.uint8) for b, lang in windows if lang == one and b] for one in languages]
    by = [x or [np.zeros(length, np.uint8)] for x in by]
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(11)
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        labels = np.arange(batch) % len(languages) if len(languages) <= batch else rng.integers(len(languages), size=batch)
        rows = []
        for k in labels:
            w = by[k][rng.integers(len(by[k]))]
            at = rng.integers(len(w) - length + 1)
            rows.append(w[at : at + length])
        grads, _ = _gradients(net, np.stack(rows, 1), labels)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * (1 - 0.9 * step / steps)
        for w, g, m, s in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def document_probabilities(net: Network, texts: list[str], window: int = WINDOW, block: int = BLOCK) -> np.ndarray:
    """(documents, languages): the mean over every byte position of the lower-cased texts; zero if empty."""
    totals, bytes_of = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    rows: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            x, own, have = np.concatenate(rows), np.concatenate(owners), np.concatenate(lengths)
            for at in range(0, len(x), block):
                part, size = np.ascontiguousarray(x[at : at + block].T), have[at : at + block]
                p = position_probabilities(net, part, size)
                if (size < window).any():
                    p *= (np.arange(window)[:, None] < size)[:, None, :]
                np.add.at(totals, own[at : at + block], p.sum(0).T)
        rows.clear(), owners.clear(), lengths.clear()
        held = 0

    for i, text in enumerate(texts):
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        bytes_of[i] = len(raw)
        for at in range(0, len(raw), window * block):
            part = raw[at : at + window * block]
            n = -(-len(part) // window)
            padded = np.zeros(n * window, np.uint8)
            padded[: len(part)] = part
            rows.append(padded.reshape(n, window))
            owners.append(np.full(n, i))
            lengths.append(np.minimum(window, len(part) - window * np.arange(n)))
            held += n
            if held >= block:
                flush()
    flush()
    return totals / np.maximum(bytes_of, 1)[:, None]


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the identifier as text leaves 2 when divided by 4; a null one counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Learn from windows of rows that are not held out and have a text and a language.

    Every language that occurs is learned.  Without any such row the network knows none.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")) & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Network.new([], HIDDEN)
    each = max(LEAST, min(SAMPLE, SAMPLE_ALL // len(counts)))
    share = rows.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, share double")
    chance = (F.shiftrightunsigned(F.xxhash64("id", F.lit("language")), 11).cast("double")) / float(1 << 53)
    chosen = rows.join(F.broadcast(share), "lang").filter(chance < F.col("share"))
    room = F.greatest(F.length("text") - CHARS, F.lit(0)) + 1
    cut = [F.substring(F.col("text"), F.pmod(F.xxhash64("id", F.lit(i)), room).cast("int") + 1, F.lit(CHARS)) for i in range(WINDOWS_EACH)]
    got = chosen.select("id", "lang", F.array(*cut).alias("w")).orderBy(F.xxhash64("id")).limit(2 * each * len(counts)).collect()
    return learn([(w.lower().encode("utf-8", "surrogatepass"), r["lang"]) for r in got for w in r["w"] if w])


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language of each whole text and its pooled probability.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the
    network knows no language.  Repeated rows each get a row; other columns play no part.
    """
    rows = pick(docs, id=id_col, text=text_col)
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, len(whole["id"]), 1000):
                b = whole.slice(at, 1000)
                texts = [t.as_py() or "" for t in b["text"]]
                usable = [bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
                p = document_probabilities(model, [t if ok else "" for t, ok in zip(texts, usable, strict=True)])
                best = p.argmax(1) if model.languages else np.zeros(len(texts), int)
                yield pa.RecordBatch.from_arrays(
                    [
                        b["id"],
                        pa.array([model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, usable, strict=True)], pa.string()),
                        pa.array([min(1.0, float(p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, usable, strict=True))], pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
