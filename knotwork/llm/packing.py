"""Packing documents into training sequences by non-negative least squares.

A document's full windows are sequences of their own.  What is left, a tail of 1 to window - 1 ids,
is packed whole: every combination of two tails, and of three that suits the histogram, that fills
a window exactly is a column; non-negative least squares finds repeat counts whose use of each
length comes nearest to the histogram of tails; the counts are rounded down to what the tails allow.
Tails left over are laid end to end, longest first, and cut at the windows' ends, the greedy
packing that wastes nothing; only the last sequence of all is padded.

The histogram has window - 1 bins whatever the data, so the solving takes a fixed size.  A tail's
place follows from its length and its number among the tails of that length, so nothing is sorted
or gathered: tasks number their own tails and a bounded table of counts by task shifts them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pick, release, small_or_shuffled, spool, worker_cache

WINDOW = 1024
END_ID = 0
#: Bytes of words and their ids that a worker remembers, about.
REMEMBERED = 24 << 20
#: Bytes of text that are encoded at once, and words in a call of the tokenizer.
SLICE = 2 << 20
CALL = 8192
#: Rows of (task, length, shift) up to which they are broadcast: about 32 MB as Spark holds them.
SHIFTS = 400_000
#: Combinations at most.
COMBINATIONS = 4096
#: Rounds of the solver.
ROUNDS = 100
#: Full windows are numbered by task: (task + 1) * TASK_SEQUENCES and on.
TASK_SEQUENCES = 1 << 40

# The characters that count as white space somewhere, as a class of the patterns below.
_SPACES = "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace())
#: A space beside other white space (or at the end after it), where words cannot be cut apart.
_CLOSE = rf"[{_SPACES}] (?:[{_SPACES}]|$)|  "
#: Words without white space at their ends, of characters whose classes all versions of Unicode in use agree on.
_PLAIN_END = r"!-~\x{a1}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{2010}-\x{2027}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}"
_PLAIN = rf"^[{_PLAIN_END}](?:[\t-\r{_PLAIN_END}]*[{_PLAIN_END}])?$"
#: How a byte-level tokenizer cuts a text into pre-tokens.
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _by_ranks(tokenizer: Tokenizer) -> tiktoken.Encoding | None:
    """A faster encoder with the same ids, if the tokenizer is plain byte-level BPE whose identifiers are its merges' ranks."""
    parts = json.loads(tokenizer.to_str())
    model, before = parts["model"], parts["pre_tokenizer"] or {}
    vocab = model.get("vocab")
    same = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    same = same and parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not same:
        return None
    added = {t["content"] for t in parts["added_tokens"]}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    byte = _byte_of()
    tokens = {t: i for t, i in vocab.items() if t not in added}
    if merged != sorted(merged) or len(tokens) != len(merged) + 256 or any(c not in byte for t in tokens for c in t):
        return None
    return tiktoken.Encoding("ranks", pat_str=_PRE_TOKEN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in tokens.items()}, special_tokens={})


class Encoder:
    """Ids of many texts at once, the same as the tokenizer's own plain call gives.

    Byte-level pre-tokens begin at every single space between other characters, so texts are cut
    there, and of all words of a batch each distinct one is encoded once, many to a call: the byte
    lengths of the tokens tell where a word's ids end.  Those calls go to an encoder by ranks that is
    built from the tokenizer's own vocabulary where that is possible, else to the tokenizer.  Texts
    with close white space or with the string of an added token are encoded whole, and words of
    uncommon characters one by one, by the tokenizer.  The words of earlier batches stay, as flat
    arrays of about ``REMEMBERED`` bytes at most.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs at once
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = _by_ranks(self.tokenizer)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.whole = "|".join([_CLOSE, *[re.escape(t) for t in sorted(added)]])
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)  # a character of a byte-level token is a byte
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text), one text after another."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each) of plain words that each follow a space."""
        parts = []
        for at in range(0, len(words), CALL):
            some = words.slice(at, CALL)
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            ids = self.ranks.encode_to_numpy(text) if self.ranks else self._each([text])[0]
            token_ends = np.cumsum(self.sizes[ids])
            word_ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            last = np.searchsorted(token_ends, word_ends)
            if len(ids) and last[-1] < len(ids) and (token_ends[last] == word_ends).all():
                parts.append((ids, np.diff(last + 1, prepend=0)))
            else:  # no byte-level tokenizer after all
                parts.append(self._each([" " + w for w in some.to_pylist()]))
        return _chained(parts)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the known words have each of the distinct ``words``; new ones are encoded and known from then on."""
        if self.ids.nbytes + self.ends.nbytes + self.words.nbytes > REMEMBERED:
            at = pc.index_in(words, value_set=self.words).drop_null()
            counts = np.diff(self.ends, prepend=0)
            self.words = self.words.take(at)
            self.ids, counts = _gathered(self.ids, self.ends - counts, counts, at.to_numpy())
            self.ends = np.cumsum(counts)
        at = pc.index_in(words, value_set=self.words)
        fresh = at.is_null()
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        new = words.filter(fresh)
        plain = pc.match_substring_regex(new, _PLAIN)
        others = new.filter(pc.invert(plain))
        ids, counts = _chained([self._joined(new.filter(plain)), self._each([" " + w for w in others.to_pylist()])])
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        at[np.flatnonzero(fresh.to_numpy(zero_copy_only=False))[order]] = len(self.words) + np.arange(len(new))
        first = int(self.ends[-1]) if len(self.ends) else 0
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, first + np.cumsum(counts)])
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end_id`` behind each, number of ids of each); a null text counts as empty."""
        return _chained([self.encode_slice(s, end_id) for s in slices(texts)])

    def encode_slice(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` at once, which takes memory of some thirty times the texts."""
        return self._slice(pc.fill_null(texts, ""), end_id)

    def _slice(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole)
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        begin = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        # entries: the words known, then the first words and whole texts, which follow no space, then the end
        places = self._places(coded.dictionary)
        heads = pc.if_else(whole, texts, pc.list_element(cut, 0)).dictionary_encode()
        known = len(self.ends)
        index = np.full(len(coded) + len(texts), known + len(heads.dictionary))
        words = np.diff(begin)
        ends = begin[1:] + np.arange(len(texts))  # a text's words, then its end
        within = np.ones(len(index), bool)
        within[ends] = False
        index[within] = places[coded.indices.to_numpy()]
        index[ends - words] = known + heads.indices.to_numpy()
        own, many = self._each(heads.dictionary.to_pylist())
        ids = np.concatenate([self.ids, own, np.array([end_id], np.uint32)])
        counts = np.concatenate([np.diff(self.ends, prepend=0), many, np.ones(1, np.int64)])
        out, many = _gathered(ids, np.cumsum(counts) - counts, counts, index)
        return out, np.add.reduceat(many, ends - words)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, about as much and at most some ``SLICE`` bytes in every part."""
    if not len(texts):
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    n = max(1, -(-int(sizes[-1]) // SLICE))
    ends = np.unique(np.searchsorted(sizes, sizes[-1] * np.arange(1, n) / n, "right") + 1) if n > 1 else []
    edges = [0, *[int(e) for e in ends if e < len(texts)], len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield texts.slice(a, b - a)


def _chained(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint32), np.zeros(0, np.int64)), *parts, strict=True))


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``ids`` that the entries of ``index`` name, one after another, and their lengths."""
    many = counts[index]
    at = np.repeat(starts[index] - (np.cumsum(many) - many), many)
    at += np.arange(len(at))
    return ids[at], many


def encoder(path: str) -> Encoder:
    def make() -> Encoder:
        made = Encoder(path)
        release()  # parsing the vocabulary takes several times what stays
        return made

    return worker_cache(f"packing {path}", make)


def token_ids(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """The ids of whole texts and ``end_id`` as little-endian unsigned 32-bit integers."""
    ids, counts = encoder(path).encode(pa.array(texts, pa.string()), end_id)
    ends = np.cumsum(counts)
    return [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, counts, strict=True)]


def combinations(hist: np.ndarray, window: int, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths (two, then three parts) that fill the window exactly.

    ``hist[n]`` counts the tails of n ids.  All pairs are there; triples of two frequent lengths and
    what they leave follow, by how often the scarcest part occurs, up to ``most``.
    """
    have = [n for n in range(1, window) if hist[n]]
    out = [(window - n, n) for n in have if 2 * n <= window and hist[window - n]]
    often = sorted(have, key=lambda n: (-hist[n], n))[:160]
    triples = {}
    for i, a in enumerate(often):
        for b in often[i:]:
            c = window - a - b
            if c > 0 and hist[c]:
                key = tuple(sorted((a, b, c), reverse=True))
                triples[key] = min(hist[n] // key.count(n) for n in key)
    out += sorted(triples, key=lambda k: (-triples[k], k))[: max(0, most - len(out))]
    return out


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], window: int, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares for the repeat counts by projected coordinate descent.

    Minimises |A x - hist| over x >= 0, where A[n, j] says how often combination j uses length n.
    """
    x, residual = [0.0] * len(combos), hist.astype(float).tolist()
    parts = [tuple(Counter(c).items()) for c in combos]
    norms = [sum(t * t for _, t in p) for p in parts]
    small = max(0.01, 1e-3 * float(hist.max(initial=0)))
    for _ in range(rounds):
        moved = 0.0
        for j, part in enumerate(parts):
            step = max(-x[j], sum(residual[n] * t for n, t in part) / norms[j])
            if step:
                x[j] += step
                for n, t in part:
                    residual[n] -= step * t
                moved = max(moved, abs(step))
        if moved < small:
            break
    return np.array(x)


def rounded(hist: np.ndarray, combos: list[tuple[int, ...]], x: np.ndarray) -> np.ndarray:
    """Whole repeat counts near x that use no length more often than it occurs."""
    left, out = hist.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for wish in (np.floor(x + 1e-9), np.full(len(combos), np.inf)):  # then what still fits whole
        for j in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[j], return_counts=True)
            n = int(min((left[lengths] // times).min(), max(0.0, wish[j] - out[j])))
            if n > 0:
                out[j] += n
                left[lengths] -= n * times
    return out


class Plan:
    """Where the i-th tail of a length goes, as bounded tables."""

    def __init__(self, hist: np.ndarray, window: int) -> None:
        combos = combinations(hist, window)
        counts = rounded(hist, combos, solve(hist, combos, window))
        self.window = window
        # For a length: the first numbers of its stretches and, for each, (sequence, offset).
        self.first: dict[int, list[int]] = {n: [0] for n in range(1, window)}
        self.place: dict[int, list[tuple[int, int]]] = {n: [] for n in range(1, window)}
        sequence = 0
        for combo, n in zip(combos, counts.tolist(), strict=True):
            if not n:
                continue
            offset = 0
            for length in combo:
                self.place[length].append((sequence, offset))
                self.first[length].append(self.first[length][-1] + n)
                offset += length
            sequence += n
        self.rest_sequence = sequence
        self.rest_start, at = {}, 0
        for length in range(window - 1, 0, -1):
            self.rest_start[length] = at
            at += (int(hist[length]) - self.first[length][-1]) * length

    def pieces(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start within the tail, length, sequence, offset) of one or two pieces."""
        first = self.first[length]
        if number < first[-1]:
            k = bisect_right(first, number) - 1
            sequence, offset = self.place[length][k]
            return [(0, length, sequence + number - first[k], offset)]
        at = self.rest_start[length] + (number - first[-1]) * length
        sequence, offset = divmod(at, self.window)
        head = min(length, self.window - offset)
        out = [(0, head, self.rest_sequence + sequence, offset)]
        if head < length:
            out.append((head, length - head, self.rest_sequence + sequence + 1, 0))
        return out


_TAILS = "task int, id {}, doc_tokens long, windows array<long>, first_window long, tail binary, number long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where ``slices`` cuts their texts."""
    for b in batches:
        at = 0
        for part in slices(b["text"]):
            yield b.slice(at, len(part))
            at += len(part)


def _tokenised(rows: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Each document's window checksums and tail, with the task's own numbering."""
    size = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, windows, coder = TaskContext.get().partitionId(), [0] * window, 0, encoder(path)
        release()  # what other operators left in this worker
        for b in _pieces(batches):
            ids, counts = coder.encode_slice(b["text"], end_id)
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
            cols: list[list] = [[], [], [], [], []]
            for total in counts.tolist():
                full, n = divmod(total, window)
                crcs = [zlib.crc32(raw[k : k + size]) for k in range(at, at + full * size, size)]
                tail = bytes(raw[at + full * size : at + 4 * total])
                for col, v in zip(cols, (total, crcs, windows, tail, seen[n]), strict=True):
                    col.append(v)
                windows += full
                seen[n] += 1
                at += 4 * total
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(b["id"]), pa.int32()), b["id"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["task", "id", "doc_tokens", "windows", "first_window", "tail", "number"],
            )
        release()

    return rows.mapInArrow(run, _TAILS.format(rows.schema["id"].dataType.simpleString()))


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has its ids and then ``end_id``; null and empty texts have that id only.  Repeated
    rows are packed each; an empty table gives no piece; other columns play no part.
    """
    spark = docs.sparkSession
    rows = spool(_tokenised(pick(docs, id=id_col, text=text_col), tokenizer_path, window, end_id), "tokenised")
    length = (F.octet_length("tail") / 4).cast("int")
    # A task's numbers start after those of the tasks before it: running sums over counts by task and length.
    counts = spool(rows.groupBy("task", length.alias("n")).agg(F.count("*").alias("c")), "counts")
    before = F.sum("c").over(Window.partitionBy("n").orderBy("task")) - F.col("c")
    shift = counts.select("task", "n", before.alias("before"))
    hist = np.zeros(window, np.int64)
    for r in counts.filter("n > 0").groupBy("n").agg(F.sum("c").alias("c")).collect():  # at most window rows
        hist[r["n"]] = r["c"]
    plan = spark.sparkContext.broadcast(Plan(hist, window))

    placed = (
        rows.withColumn("n", length)
        .join(small_or_shuffled(shift, counts.count(), SHIFTS), ["task", "n"])
        .select("task", "id", "doc_tokens", "windows", "first_window", "tail", (F.col("number") + F.col("before")).alias("number"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value
        names = ("task", "doc_tokens", "windows", "first_window", "tail", "number")
        for b in batches:
            take: list[int] = []
            cols: list[list[int]] = [[], [], [], [], [], []]
            for i, (task, total, windows, first, tail, number) in enumerate(zip(*[b[c].to_pylist() for c in names], strict=True)):
                first += (task + 1) * TASK_SEQUENCES
                found = [(k * window, window, crc, first + k, 0) for k, crc in enumerate(windows)]
                base = len(windows) * window
                if tail:
                    found += [(base + s, n, zlib.crc32(tail[4 * s : 4 * (s + n)]), q, o) for s, n, q, o in where.pieces(len(tail) // 4, number)]
                for s, n, crc, q, o in found:
                    take.append(i)
                    for col, v in zip(cols, (s, n, crc, total, q, o), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(pa.array(take, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = placed.schema["id"].dataType.simpleString()
    out = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, out.format(kind))
