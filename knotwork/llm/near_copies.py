"""Near copies by the Jaccard similarity of word shingles: SimHash and BK-trees propose, the sets decide.

Two texts whose sets of five-word shingles have a similarity of 0.8 differ in about 10 of 64 SimHash
bits, and in up to 20 now and then.  No bits are left that all such pairs agree in and that part the
rest, so fingerprints do not meet in shards by masks here but by the smallest shingle hashes of their
texts: of the ``LOWEST`` smallest hashes of two sets together, each is in both sets with the
probability of their similarity, so that two sets of similarity 0.8 meet in no shard with a probability
of 0.2 ** 12, one in 200 million.  In a shard, a BK-tree gives the fingerprints within a radius that
follows from the similarity (21 bits for 0.8; one pair in some ten thousand of just that similarity
lies beyond), a comparison of the sizes and of the 32 smallest hashes rules out most others (as rarely
a similar pair), and what is left is compared shingle by shingle, from the texts themselves.  Sets that
are smaller than that are compared whole, within a wider radius.

In some turns every text is compared with one of those that it meets in each of its shards; then, where
texts that meet are still in different components, all such pairs are.  So a large group that the
turns have joined costs no more than its size.  Of a group that they have not joined, the pairs that may
be similar grow with the square of its size, so they are never rows: a shard gives a spanning forest of them,
the trees of all shards together are clusters that no such pair leaves, and the sets of a cluster are
compared where they meet, pair by pair, until all are in one component or none is left.  That gives a
spanning forest again.  Shards and clusters of any size are cut into blocks, pairs of which are tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pick, release, skew_join, small_or_shuffled, spool
from .simhash import SEED, components, hexadecimal

WORDS = 5
SIMILARITY = 0.8
#: Smallest hashes of a set by which it meets others, and by which two sets are compared at first.
LOWEST, SKETCH = 12, 32
#: Standard deviations that similar sets are given in their fingerprints' distance and in what their sketches share.
DEVIATIONS = 3.8
#: Sizes below which fingerprints stray more, and by how many bits.
SMALL, STRAY = 64, 8
#: Turns of one set in each shard before all remaining pairs; bears on cost alone.
TURNS = 2
#: Members of a block of a shard or cluster, values of a leaf of a tree, links in a batch.
BLOCK, LEAF, LINKS = 4096, 512, 100_000
#: Hashes of a block of a cluster, about, and those looked up at once.
HASHES, LOOKED_UP = 1 << 20, 1 << 20
#: Sketches compared at once, and what fills those of small sets.
SKETCHES = 4096
#: Texts worked on at once.
ROWS = 1000
#: Odd numbers by which the hashes of a shingle's words are told apart.
PLACES = [np.uint64(int.from_bytes(xxhash.xxh64_digest(str(k))) | 1) for k in range(64)]
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words hash 0.

    Words are as for fingerprints.  A shingle's hash mixes the XXH64 hashes of its words, each times
    a number of its place, so that whole texts are hashed by arrays.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(1, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n * SEED, np.uint64)
    for k in range(n):
        h += own[k : len(w) - n + 1 + k] * PLACES[k % len(PLACES)] + np.uint64(k)
    # the finisher of splitmix64: all bits depend on all
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def radius_for(similarity: float) -> int:
    """The bits of 64 within which the fingerprints of sets of that similarity are."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(64 * p + DEVIATIONS * math.sqrt(64 * p * (1 - p)))


def signature(found: np.ndarray) -> int:
    """The unsigned 64-bit digest of a whole set."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def fingerprint(found: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class Tree:
    """A BK-tree over 64-bit integers: children keyed by their distance to the parent's value, with leaves that are scanned."""

    def __init__(self, values: np.ndarray, places: np.ndarray | None = None) -> None:
        self.values, self.places = values, np.arange(len(values)) if places is None else places
        self.children: dict[int, Tree] = {}
        if len(values) > LEAF:
            distance = np.bitwise_count(values ^ values[0])
            if distance.any():
                self.children = {int(d): Tree(values[distance == d], self.places[distance == d]) for d in np.unique(distance)}

    def within(self, value: np.uint64, radius: int) -> np.ndarray:
        """Places of the values at most ``radius`` bits away."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.children:
                distance = int(np.bitwise_count(node.values[0] ^ value))
                todo += [kid for d, kid in node.children.items() if abs(d - distance) <= radius]
            else:
                out.append(node.places[np.bitwise_count(node.values ^ value) <= radius])
        return np.concatenate(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at once."""
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.slice(at, ROWS)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the signed 64-bit signature of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((signature(shingles(t.as_py(), words)) for t in b["text"]), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id=id_col, text=text_col).withColumn("t", F.xxhash64("text"))


def _summaries(rows: DataFrame, words: int) -> DataFrame:
    """(id, t, fp, n, print, low): a row's text hash, its set's signature, size, SimHash and smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in _pieces(batches):
            fps, sizes, prints, low = [], [], [], []
            for t in b["text"]:
                s = shingles(t.as_py(), words)
                fps.append(signature(s))
                sizes.append(len(s))
                prints.append(fingerprint(s))
                low.append(s[:SKETCH].view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, prints)]
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["t"], signed[0], pa.array(sizes, pa.int32()), signed[1], pa.array(low, pa.list_(pa.int64()))], ["id", "t", "fp", "n", "print", "low"]
            )
        release()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t long, fp long, n int, print long, low array<long>")


def _sets(fps: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(fp, s): the sets of these signatures, made again from the texts."""
    wanted = spool(nodes.join(fps, "fp", "left_semi").select("t").distinct(), "wanted")
    texts = rows.select("t", "text").join(small_or_shuffled(wanted, wanted.count()), "t", "left_semi").dropDuplicates(["t"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            sets = [shingles(t.as_py(), words) for t in b["text"]]
            fps = np.fromiter(map(signature, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "s"])
        release()

    return spool(texts.select("text").mapInArrow(make, "fp long, s binary").dropDuplicates(["fp"]), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, made again from the texts, are similar enough."""
    if pairs.isEmpty():
        return pairs
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), nodes, rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(b["x"], b["y"], strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], ["a", "b"])
        release()

    left = pairs.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    both = left.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _stars(entries: DataFrame, turn: int, similarity: float, largest: int) -> DataFrame:
    """(a, b): in each shard one text, another in every turn, with those of other components that may be similar."""
    order = F.col("fp") if turn == 0 else F.xxhash64("fp", "h", F.lit(turn))
    one = entries.groupBy("h").agg(F.min(F.struct(order.alias("o"), "fp", "n", "print", "root")).alias("b"), F.min("root").alias("r"), F.max("root").alias("top"), F.count("*").alias("many"))
    both = skew_join(entries, one.filter("r != top").select("h", "b", "many"), "h", "many", largest)
    fits = F.least("n", "b.n") >= similarity * F.greatest("n", "b.n") - 1e-9
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("b.print"))) <= radius_for(similarity) + F.when(F.least("n", "b.n") < SMALL, STRAY).otherwise(0)
    return both.filter((F.col("root") != F.col("b.root")) & fits & near).select(F.greatest("fp", "b.fp").alias("a"), F.least("fp", "b.fp").alias("b")).distinct()


def _blocks(entries: DataFrame, largest: int) -> DataFrame:
    """Rows (left, right: arrays of members): pairs of blocks of the shards whose members are in several components."""
    sizes = entries.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("top"), F.count("*").alias("many")).filter("r != top")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = skew_join(entries, sizes.select("h", "many"), "h", "many", largest)
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # a block meets itself and each other once: it goes to its pairs on one side or the other
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"))))
    rows = rows.select("h", pair.alias("p"), own.alias("o"), F.struct("fp", "n", "print", "root", "low").alias("m"))
    return rows.groupBy("h", "p").agg(
        F.collect_list(F.when(F.col("o") == F.col("p.i"), F.col("m"))).alias("left"), F.collect_list(F.when((F.col("o") == F.col("p.j")) & (F.col("p.i") != F.col("p.j")), F.col("m"))).alias("right")
    )


class Groups:
    """Labels of members, those of one group alike, and the links that have joined groups."""

    def __init__(self, fp: np.ndarray, labels: np.ndarray) -> None:
        self.fp, self.labels, self.links = fp, labels, []

    def others(self, i: int, at: np.ndarray) -> np.ndarray:
        return at[self.labels[at] != self.labels[i]]

    def join(self, i: int, at: np.ndarray) -> None:
        """One link from the member i to each group of the members ``at``, which is then its own."""
        labels, first = np.unique(self.labels[at], return_index=True)
        self.links += [(max(self.fp[i], self.fp[j]), min(self.fp[i], self.fp[j])) for j in at[first]]
        if len(labels) == 1:
            self.labels[self.labels == labels[0]] = self.labels[i]
        else:
            self.labels[np.isin(self.labels, labels)] = self.labels[i]


def _candidates(entries: DataFrame, similarity: float, largest: int) -> DataFrame:
    """(a, b): a spanning forest of each shard's pairs that have different roots and may be similar, by a BK-tree of each block."""
    radius = radius_for(similarity)

    def fields(member: pa.Array) -> tuple[np.ndarray, ...]:
        # in order, so that a task that runs again gives the same forest
        order = np.argsort(member.field("fp").to_numpy(zero_copy_only=False))
        fp, n, bits, root = (member.field(c).to_numpy(zero_copy_only=False)[order] for c in ("fp", "n", "print", "root"))
        return fp, n, bits.view(np.uint64), root, sketches(member.field("low"))[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"], strict=True):
                own = fields(left.values)
                alone, many = not len(right), len(own[0])
                fp, n, bits, root, low = own if alone else (np.concatenate(x) for x in zip(own, fields(right.values), strict=True))
                groups, start = Groups(fp, np.arange(len(fp))), 0 if alone else many
                tree = Tree(bits[start:])
                for i in range(many):
                    at = start + tree.within(bits[i], radius + STRAY * int(n[i] < SMALL / similarity))
                    at = groups.others(i, at[(root[at] != root[i]) & (at > i)])
                    small, large = np.minimum(n[i], n[at]), np.maximum(n[i], n[at])
                    at = at[small >= similarity * large - 1e-9]
                    for k in range(0, len(at), SKETCHES):
                        some = groups.others(i, at[k : k + SKETCHES])
                        some = some[alike(low[i], n[i], low[some], n[some], similarity)]
                        if len(some):
                            groups.join(i, some)
                held += groups.links
                if len(held) >= LINKS:
                    yield _batch(held)
                    held = []
        yield _batch(held)
        release()

    return _blocks(entries, largest).select("left", "right").mapInArrow(run, "a long, b long").distinct()


def _linked(forest: DataFrame, rooted: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the similar sets with different roots within each tree of ``forest``, by their whole sets."""
    if forest.isEmpty():
        return forest
    stars = components(forest).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    stars = spool(stars.unionByName(stars.select(F.col("cluster").alias("fp"), "cluster").distinct()), "clusters")
    sets = _sets(stars.select("fp"), nodes, rows, words)
    members = spool(stars.join(rooted.select("fp", "root"), "fp").join(nodes.select("fp", "n"), "fp"), "members")
    # what is all of one root has no more to find
    sizes = members.groupBy("cluster").agg(F.min("root").alias("r"), F.max("root").alias("top"), F.count("*").alias("many"), F.sum("n").alias("hashes")).filter("r != top")
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("hashes") / HASHES)).cast("int")
    cut = skew_join(members, sizes.select("cluster", "many", blocks.alias("blocks")), "cluster", "many")
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"))))
    cut = cut.select("fp", "root", "n", "cluster", own.alias("o"), pair.alias("p")).select("fp", "root", "n", "cluster", "p.i", "p.j", (F.col("o") == F.col("p.i")).alias("left"))
    met = cut.join(sets, "fp").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, fp, root, left, found = [], None, [], [], [], []
        for b in batches:
            which = [b[c].to_numpy() for c in ("cluster", "i", "j")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in which], axis=0)) + 1
            for at, end in zip([0, *edges], [*edges, len(b)], strict=True):
                now = tuple(int(x[at]) for x in which) if end else key
                if now != key:
                    held += compared(fp, root, left, found, key, similarity)
                    key, fp, root, left, found = now, [], [], [], []
                    if len(held) >= LINKS:
                        yield _batch(held)
                        held = []
                part = b.slice(at, end - at)
                fp += part["fp"].to_pylist()
                root += part["root"].to_pylist()
                left += part["left"].to_pylist()
                found += [np.frombuffer(s.as_py(), np.uint64) for s in part["s"]]
        held += compared(fp, root, left, found, key, similarity)
        yield _batch(held)
        release()

    return met.select("cluster", "i", "j", "fp", "root", "left", "s").mapInArrow(run, "a long, b long").distinct()


def compared(fp: list[int], root: list[int], left: list[bool], sets: list[np.ndarray], key: tuple[int, int, int] | None, similarity: float) -> list[tuple[int, int]]:
    """Links that join the members of similar sets, of a block or between two blocks, whose roots differ.

    Every pair is compared by its whole sets, but for those that links have put into one group before.
    """
    if len(fp) < 2:
        return []
    alone = key[1] == key[2]
    groups = Groups(np.array(fp), np.unique(np.array(root), return_inverse=True)[1])
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(place.astype(np.int32), np.cumsum(n)[:-1])
    own, across = np.zeros(len(every), bool), np.flatnonzero(~np.array(left))
    del every, place
    for i in range(len(fp)) if alone else np.flatnonzero(left):
        at = groups.others(i, np.arange(i + 1, len(fp)) if alone else across)
        at = at[np.minimum(n[i], n[at]) >= similarity * np.maximum(n[i], n[at]) - 1e-9]
        if not len(at):
            continue
        own[ids[i]] = True
        pieces = np.cumsum(n[at]) // LOOKED_UP
        for piece in range(pieces[0], pieces[-1] + 1):
            some = at[np.searchsorted(pieces, piece) : np.searchsorted(pieces, piece, "right")]
            some = groups.others(i, some)
            if not len(some):
                continue
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            both = np.add.reduceat(own[np.concatenate([ids[j] for j in some])], starts, dtype=np.int64)
            some = some[both >= similarity * (n[i] + n[some] - both) - 1e-9]
            if len(some):
                groups.join(i, some)
        own[ids[i]] = False
    return groups.links


def sketches(low: pa.Array) -> np.ndarray:
    """(sets, SKETCH) unsigned hashes in order, with the largest number behind those of smaller sets."""
    sizes = np.diff(low.offsets.to_numpy())
    out = np.full((len(low), SKETCH), NOTHING)
    out[np.arange(SKETCH) < sizes[:, None]] = low.flatten().to_numpy().view(np.uint64)
    return out


def alike(own: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the smallest hashes of a set of n have enough in common with those of others: of sets that are all there, exactly."""
    both = np.sort(np.concatenate([np.broadcast_to(own, others.shape), others], axis=1), axis=1)
    again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NOTHING)
    place = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), ~again], axis=1), axis=1)  # of each hash among the distinct ones
    common = again.sum(1)
    whole = (n <= SKETCH) & (sizes <= SKETCH)
    least = (again & (place[:, 1:] <= SKETCH)).sum(1)
    share = similarity * SKETCH - DEVIATIONS * math.sqrt(similarity * (1 - similarity) * SKETCH)
    return np.where(whole, common >= similarity * (n + sizes - common) - 1e-9, least >= share)


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    got = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, fingerprint, component_id, component_root for each row, as ``simhash.near_duplicates`` has them.

    The fingerprint is the signature of the row's set; sets are linked if their similarity reaches
    ``similarity``.  Texts without a word have equal sets.  Repeated rows each get a row; an empty table
    gives an empty result; other columns play no part.
    """
    texts = _texts(docs, id_col, text_col)
    rows = spool(_summaries(texts, words), "summaries")
    nodes = rows.groupBy("fp").agg(F.count("*").alias("rows"), F.min("id").alias("low_id"), F.min(F.struct("t", "n", "print", "low")).alias("x"))
    nodes = spool(nodes.select("fp", "rows", "low_id", "x.t", "x.n", "x.print", "x.low"), "nodes")
    entries = nodes.select("fp", "n", "print", F.explode(F.slice("low", 1, LOWEST)).alias("h"))
    shared = entries.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1")
    shared = spool(shared, "shared")
    largest = shared.agg(F.max("many")).first()[0] or 0
    entries = spool(skew_join(entries, shared, "h", "many", largest).drop("many"), "entries")
    rooted = nodes.select("fp", "low_id", "rows", F.col("fp").alias("root"))
    tried = linked = None
    for turn in range(TURNS):
        stars = _stars(entries.join(rooted.select("fp", "root"), "fp"), turn, similarity, largest)
        stars = spool(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
        found = spool(_verified(stars, nodes, texts, words, similarity), "linked")
        tried = stars if tried is None else tried.unionByName(stars)
        if found.isEmpty():
            break
        linked = found if linked is None else linked.unionByName(found)
        rooted = _rooted(nodes, linked)
    members = entries.join(rooted.select("fp", "root"), "fp").join(nodes.select("fp", "low"), "fp")
    forest = spool(_candidates(members, similarity, largest), "forest")
    found = spool(_linked(forest, rooted, nodes, texts, words, similarity), "linked")
    if not found.isEmpty():
        rooted = _rooted(nodes, found if linked is None else linked.unionByName(found))
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count("*").alias("many"))
    named = skew_join(rooted.select("fp", "root", "rows"), lowest, "root", "many").select("fp", "root", "rows", "component_id")
    out = skew_join(rows.select("id", "fp"), named, "fp", "rows")
    return out.select(F.col("id").alias("doc_id"), hexadecimal("fp").alias("fingerprint"), "component_id", hexadecimal("root").alias("component_root"))


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, low_id, rows, root): the nodes with the smallest of their component."""
    stars = components(edges)
    own = nodes.select("fp", "low_id", "rows").join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    return spool(own.withColumn("root", F.coalesce("root", "fp")), "rooted")
