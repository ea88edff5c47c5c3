"""Exact deduplication by tree-merging sorted runs of text digests (DataFrame functions only).

Every input partition makes one run: its rows' digests, each with the smallest identifier and the
number of copies seen so far.  Runs are merged in binomial rounds: in round t, runs whose numbers
agree above bit 3t meet, and a sorted merge (sort aggregation) keeps the verified smallest
identifier of each digest.  The root's answer then goes down to the leaf runs and from these to
the rows, so that a text with a third of all rows is never one join key: at the leaves it is as
many keys as there are runs.  Only digests are shuffled; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, spool

#: Runs that one merge takes: 2 ** FAN_BITS.
FAN_BITS = 3
#: Leaf runs at most (input partitions share runs beyond that): 2 ** MAX_BITS.
MAX_BITS = 12
#: A run of white space that is not one plain space; the others need no replacing.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_KEY = ("__sha", "__bytes", "__xx")


def normalised(text: Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


def _merge(df: DataFrame) -> DataFrame:
    """One row for each digest of a run.

    Rows meet only if SHA-256, length and XXH64 all agree, which verifies the digest.  The minimum
    is over a struct, which Spark computes by sort aggregation: each run is sorted by digest.
    """
    return df.groupBy("__run", *_KEY).agg(F.min("__best").alias("__best"), F.sum("__n").alias("__n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal.  Of equal texts the smallest identifier stays, a null one only
    if there is no other; of rows that repeat an identifier with the same text exactly one is
    ``kept``.  An empty table gives an empty result; other columns play no part.
    """
    rows = pick(docs, __id=id_col, __t=text_col).select("__id", normalised(F.col("__t")).alias("__t"))
    rows = rows.select(
        "__id",
        F.spark_partition_id().alias("__run"),
        F.monotonically_increasing_id().alias("__row"),
        F.unhex(F.sha2("__t", 256)).alias("__sha"),
        F.octet_length("__t").alias("__bytes"),
        F.xxhash64("__t").alias("__xx"),
    )
    rows = spool(rows, "digests")  # run and row numbers are facts from here on
    last = rows.agg(F.max("__run")).first()[0] or 0
    bits = min(MAX_BITS, max(1, int(last).bit_length()))
    rows = rows.withColumn("__run", F.pmod("__run", F.lit(1 << bits)))

    best = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    leaves = _merge(rows.select("__run", *_KEY, best.alias("__best"), F.lit(1).cast("long").alias("__n")))
    level, done = leaves, 0
    while done < bits:
        level = _merge(level.withColumn("__run", F.shiftright("__run", FAN_BITS)))
        done += FAN_BITS
    root = level.select(*_KEY, "__best", "__n")

    down = leaves.select("__run", *_KEY).join(root, list(_KEY))
    return rows.join(down, ["__run", *_KEY]).select(
        F.col("__id").alias("doc_id"),
        F.col("__best.id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__best.row") == F.col("__row")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )
