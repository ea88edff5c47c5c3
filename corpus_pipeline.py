"""The corpus pipeline: toxic documents go, then exact and near copies; personal data is replaced; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next one's documents.  All but the last return the columns
of their input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import exact_dedup, near_copies, packing, pii, simhash, toxicity
from knotwork.llm.common import indexed, release_heaps, skew_join, small_or_shuffled, spool

#: Documents scored at or above this go.
TOXIC = 0.5


def _only_kept(docs: DataFrame, verdicts: DataFrame, key_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, key, kept) keep.

    Where identifiers are unique, the dropped ones decide.  Rows whose identifier repeats or is
    null are told apart by a key of their text, which ``key_of`` gives (__id, __key, columns);
    of repeated rows one stays.
    """
    names = docs.columns
    at = names.index("doc_id")
    rows = indexed(docs)
    odd = spool(verdicts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    dropped = spool(verdicts.filter("NOT kept").select("doc_id").distinct().join(odd, "doc_id", "left_anti"), "dropped")
    none_odd = odd.isEmpty()
    plain = rows.join(small_or_shuffled(dropped, dropped.count()), rows[f"__c{at}"] == dropped["doc_id"], "left_anti")
    if none_odd:
        return plain.toDF(*names)
    few = small_or_shuffled(odd, odd.count())
    same = F.col(f"__c{at}").eqNullSafe(few["doc_id"])
    plain = plain.join(few, same, "left_anti")
    special = key_of(rows.join(few, same, "left_semi").toDF(*names)).toDF("__key", *[f"__c{i}" for i in range(len(names))])
    kept = verdicts.filter("kept").select("doc_id", "key").distinct()
    match = F.col(f"__c{at}").eqNullSafe(kept["doc_id"]) & (F.col("__key") == kept["key"])
    special = special.join(kept, match, "left_semi").dropDuplicates(["__key", f"__c{at}"]).drop("__key")
    return plain.unionByName(special).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at ``TOXIC`` or above go; the rest, null and empty texts too, stay as they are.

    The model learns from the labels of rows that ``toxicity.held_out`` leaves; without any, nothing goes.
    Repeated rows and rows without an identifier are scored one by one, by their own text.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns
    scored = toxicity.with_score(docs, model).toDF(*[f"__c{i}" for i in range(len(names))], "__score")
    return scored.filter(F.col("__score") < TOXIC).drop("__score").toDF(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space (null and empty ones are equal) the row of the smallest identifier stays.

    A row without an identifier stays only if there is no other; of rows that repeat an identifier and text, one.
    """
    found = exact_dedup.exact_duplicates(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept")

    def key_of(rows: DataFrame) -> DataFrame:
        text = F.col(f"__c{rows.columns.index('text')}")
        return indexed(rows).select(F.sha2(exact_dedup.normalised(text), 256).alias("__key"), "*")

    return _only_kept(docs, spool(found, "copies"), key_of)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest identifier, null ones last.

    Components are those of texts whose shingles of five words are similar to 0.8 or more; texts
    without a word are alike.  Of rows that repeat an identifier and text, one stays.
    """
    release_heaps(spark)
    found = spool(simhash.near_duplicates(docs, words=near_copies.WORDS, similarity=near_copies.SIMILARITY), "components")
    order: Column = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fingerprint").alias("fp"))
    best = found.groupBy("component_root").agg(F.min(order).alias("best"), F.count("*").alias("many"))
    verdicts = skew_join(found, best, "component_root", "many", found.count()).select("doc_id", F.col("fingerprint").alias("key"), (order == F.col("best")).alias("kept"))

    def key_of(rows: DataFrame) -> DataFrame:
        at = rows.columns.index("text")
        plain = indexed(rows)
        own = near_copies.signatures(plain.select(F.sha2(F.coalesce(F.col(f"__c{at}"), F.lit("")), 256).alias("id"), F.col(f"__c{at}").alias("text")).distinct(), "id", "text")
        key = own.select(F.col("id").alias("__sha"), simhash.hexadecimal("fp").alias("__key"))
        joined = plain.withColumn("__sha", F.sha2(F.coalesce(F.col(f"__c{at}"), F.lit("")), 256)).join(key.dropDuplicates(["__sha"]), "__sha")
        return joined.select("__key", *plain.columns)

    return _only_kept(docs, spool(verdicts, "near"), key_of)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities of the text are replaced; ``n_chars``, where there is such a column, follows the text where that changed.

    No row goes; null, empty and repeated texts are as ``pii.replace`` has them.
    """
    names = docs.columns
    done = pii.replace(docs).toDF(*[f"__c{i}" for i in range(len(names))], "__n")
    if "n_chars" in names:
        c = f"__c{names.index('n_chars')}"
        length = F.length(f"__c{names.index('text')}").cast(done.schema[c].dataType)
        done = done.withColumn(c, F.when(F.col("__n") > 0, length).otherwise(F.col(c)))
    return done.drop("__n").toDF(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as ``packing.pack`` has them: null and empty texts are one id, repeated rows are packed each."""
    release_heaps(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", replace_private),
    ("packing", pack),
]

#: SQL cannot express the first stage (a learned model); the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
