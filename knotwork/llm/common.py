"""Helpers that several operators share: column picking, spooled tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spool import folder as shared_folder
from ..sources.spool import spool

#: Rows of (id) pairs up to which a counted table may be broadcast: 32 MB at 16 bytes a row.
BROADCAST_ROWS = 2_000_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by their exact names under new ones.

    Other columns may have names that differ in case only or occur twice; those are left out
    before any name is resolved.  ``pick(df, a="doc_id")`` has the one column ``a``.
    """
    names = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"__c{names.index(old)}").alias(new) for new, old in columns.items()])


def indexed(df: DataFrame) -> DataFrame:
    """The same rows under the column names __c0, __c1, ...; ``df.columns`` gives back the old ones."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def small_or_shuffled(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound, else the frame as it is."""
    return F.broadcast(df) if rows <= bound else df


#: Rows of one key from which it is hot.
HOT = 100_000


def skew_join(big: DataFrame, small: DataFrame, on: str, count: str, largest: int | None = None, hot: int | None = None) -> DataFrame:
    """Inner join with a side that has each key once and, in the column ``count``, how many rows of ``big`` have it.

    ``largest``, if known, is the largest such count.

    Keys of more than ``hot`` rows, which are few whatever the data (one in ``hot`` rows at most), are
    broadcast while their number is within its bound, so that their rows stay where they are; the
    others are shuffled.
    """
    hot = HOT if hot is None else hot
    if largest is not None and largest <= hot:
        return big.join(small, on)
    heavy = small.filter(F.col(count) > hot)
    n = heavy.count()
    if not n or n > BROADCAST_ROWS // 20:
        return big.join(small, on)
    heavy = F.broadcast(heavy)
    rest = big.join(heavy.select(on), on, "left_anti").join(small.filter(F.col(count) <= hot), on)
    return big.join(heavy, on).unionByName(rest)


_CACHES: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What an operator remembers in a Python worker; workers go on to other operators, whose memory it must not take.

    Asking for one cache forgets all others.
    """
    if name not in _CACHES:
        if _CACHES:
            _CACHES.clear()
            release()
        _CACHES[name] = make()
    return _CACHES[name]


def forget() -> None:
    """Forget what any operator has remembered in this worker."""
    if _CACHES:
        _CACHES.clear()
        release()


def release() -> None:
    """Give freed memory back to the system, so that idle workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def release_heaps(spark: SparkSession) -> None:
    """Have the executors collect their heaps and give back what earlier work left in them, before work that is done in Python.

    A heap grows as far as it may and keeps that until a full collection, beside which there may be no
    room for Python workers.  Twice a core: tasks at once share a collection, and the first frees what the second compacts.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


class Remembered:
    """A dictionary of two generations, bounded by bytes: what was not asked for during the last one is forgotten."""

    #: What an entry takes besides its key's and value's own bytes, about.
    ENTRY = 200

    def __init__(self, size: int) -> None:
        self.half, self.young, self.old, self.used = size // 2, {}, {}, 0

    def get(self, key: str) -> object | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: object) -> None:
        if len(key) > 64:
            return
        cost = self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 8)
        if self.used + cost > self.half:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[key] = value
        self.used += cost
