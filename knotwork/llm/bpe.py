"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The ranks that pairs of neighbours can merge into are few integers below the vocabulary's size.
A bucket for each rank holds the list positions whose pair has that rank; a bitmap of three levels
of 64-bit words marks the buckets that are not empty, so that find-first-set gives the next rank in
three steps whatever the length of the pre-token.  Entries are not removed when a neighbour merges;
they are stale if the pair at their position no longer has the bucket's rank, and are skipped.  One
pre-token of n bytes takes O(n log n) steps (each bucket is emptied in position order), where
rescanning would take O(n * n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Remembered, pick, worker_cache

#: Bytes of stretches of text and their ids that a worker remembers, and half as many of tokens; others are encoded anew.
CACHE = 160 << 20
#: Bytes of text that are encoded at once, about.
SLICE = 4 << 20
#: Bytes of a pre-token up to which a bucket is one bitmap of positions.
SHORT = 256
#: A space beside other white space (or at the end after it), where words cannot be cut apart.
CLOSE_SPACE = re.compile(r"\s (?:\s|\Z)|  ")


class RankQueue:
    """Buckets by rank below a bitmap of three levels."""

    def __init__(self, size: int) -> None:
        if size > 1 << 18:
            raise ValueError("at most 2 ** 18 ranks")
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}  # heaps of positions

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        """The smallest rank with its smallest position."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] &= ~(1 << (rank & 63))
            if not self.low[b]:
                self.mid[a] &= ~(1 << (b & 63))
                if not self.mid[a]:
                    self.top &= ~(1 << a)
        return rank, position


class Codec:
    """Encoder and decoder for one file of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.queue = RankQueue(len(self.pieces))
        self.stretches, self.tokens = Remembered(CACHE), Remembered(CACHE // 2)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: always the pair of smallest rank, the leftmost first."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        return self._merge_short(raw) if len(raw) <= SHORT else self._merge_long(raw)

    def _merge_short(self, raw: bytes) -> list[int]:
        """The queue in local variables: two levels of 256-bit words over buckets that are bitmaps of positions."""
        get, n = self.ranks.get, len(raw)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n))
        now = [get(raw[i : i + 2]) for i in range(n - 1)]  # rank of the pair that begins here, if any
        now.append(None)
        top, low, buckets, bit = 0, {}, {}, 1
        for rank in now:
            if rank is not None:
                if rank in buckets:
                    buckets[rank] |= bit
                else:
                    buckets[rank] = bit
                    word = rank >> 8
                    low[word] = low.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
            bit <<= 1
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = (bucket & -bucket).bit_length() - 1
            bucket &= bucket - 1
            if bucket:
                buckets[rank] = bucket
            else:
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top &= top - 1
            if now[i] != rank:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            now[j] = None
            before[k] = i
            now[i] = rank = get(raw[i : end[k]]) if k < n else None
            if rank is not None:
                if rank in buckets:
                    buckets[rank] |= 1 << i
                else:
                    buckets[rank] = 1 << i
                    word = rank >> 8
                    low[word] = low.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
            h = before[i]
            if h >= 0:
                now[h] = rank = get(raw[h:k])
                if rank is not None:
                    if rank in buckets:
                        buckets[rank] |= 1 << h
                    else:
                        buckets[rank] = 1 << h
                        word = rank >> 8
                        low[word] = low.get(word, 0) | 1 << (rank & 255)
                        top |= 1 << word
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with buckets that are heaps, whose cost does not grow with the pre-token's length."""
        n, ranks = len(raw), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
        before = list(range(-1, n))
        push, pop, get = self.queue.push, self.queue.pop, ranks.get
        for i in range(n - 1):
            if (rank := get(raw[i : i + 2])) is not None:
                push(rank, i)
        while (found := pop()) is not None:
            rank, i = found
            j = end[i]
            if not j or j >= n or get(raw[i : end[j]]) != rank:
                continue  # stale
            k = end[i] = end[j]
            end[j] = 0
            before[k] = i
            if k < n and (rank := get(raw[i : end[k]])) is not None:
                push(rank, i)
            if (h := before[i]) >= 0 and (rank := get(raw[h:k])) is not None:
                push(rank, h)
        return [ranks[raw[i : end[i]]] for i in range(n) if end[i]]

    def _token(self, token: str) -> bytes:
        """Little-endian ids of one match of the pattern."""
        found = self.tokens.get(token)
        if found is None:
            ids = self.merge(token.encode("utf-8"))
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.tokens.put(token, found)
        return found

    def _fresh(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of new stretches, each of which begins with a space that begins a pre-token.

        Those with no other white space at either end are cut by the pattern in one go.
        """
        out = {s: b"".join(map(self._token, self.find(s))) for s in stretches if s[-1].isspace() or s[1].isspace()}
        plain = [s for s in stretches if s not in out]
        sizes = iter(map(len, plain))
        left, parts, at = next(sizes, 0), [], 0
        for token in self.find("".join(plain)):
            parts.append(self._token(token))
            left -= len(token)
            if not left:
                out[plain[at]] = b"".join(parts)
                left, parts, at = next(sizes, 0), [], at + 1
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each text; a null one counts as empty."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        edges = np.flatnonzero(np.diff(sizes // SLICE, prepend=0, append=-1)).tolist()  # where another slice begins, and the end
        return [ids for a, b in zip([0, *edges], edges, strict=False) if a < b for ids in self._slice(texts.slice(a, b - a))]

    def _slice(self, texts: pa.Array) -> list[bytes]:
        """``encode_all`` at once.

        A single space between other characters always begins a pre-token, so texts without close
        white space are cut there and each distinct stretch is looked up once; other texts are cut by the pattern.
        """
        plain = [t or "" for t in texts.to_pylist()]
        whole = {i: t for i, t in enumerate(plain) if CLOSE_SPACE.search(t)}
        for i in whole:
            plain[i] = ""
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        words, follows = cut.flatten(), np.ones(int(begin[-1]), bool)
        follows[begin[:-1]] = False  # a text's first word follows no space
        heads = words.take(pa.array(begin[:-1])).to_pylist()
        coded = words.filter(pa.array(follows)).dictionary_encode()
        stretches = [" " + w for w in coded.dictionary.to_pylist()]
        found = list(map(self.stretches.get, stretches))
        fresh = self._fresh([s for s, ids in zip(stretches, found, strict=True) if ids is None])
        for s, ids in fresh.items():
            self.stretches.put(s, ids)
        found = pa.array([fresh[s] if ids is None else ids for s, ids in zip(stretches, found, strict=True)], pa.large_binary())
        joined = found.take(coded.indices)  # its bytes are the ids of all stretches in turn
        data = memoryview(joined.buffers()[2] or b"")
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64))])
        ends = ends[begin - np.arange(len(begin))].tolist()  # of the stretches before each text
        out = []
        for i, head in enumerate(heads):
            first = b"".join(map(self._token, self.find(whole.get(i, head))))
            out.append(first + data[ends[i] : ends[i + 1]])
        return out

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and file."""
    return worker_cache(f"bpe {path} {pattern}", lambda: Codec.load(path, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary) for each row; a null text counts as empty.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes they stand for.
    ``ranks_path`` must be readable on every executor (an installed vocabulary file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for b in batches:
            ids = coder.encode_all(b["text"])
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"]
            )

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, without moving ids out of the worker.

    Null and empty texts have no token and the digests of the empty string.  Repeated rows each get
    a row; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = codec(ranks_path, pattern), hashlib.sha256
        for b in batches:
            counts, first, second = [], [], []
            for ids in coder.encode_all(b["text"]):
                counts.append(len(ids) // 4)
                first.append(sha(ids).hexdigest())
                second.append(sha(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
