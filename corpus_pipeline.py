"""Five stages over documents, each written as Parquet and read again as the next one's input.

All but the last return the columns of documents, extra ones included. Defined results: rows with a null doc_id go through every stage on
their own (near duplicates and repeated strings leave them as they are); rows with one doc_id and different texts are different
documents to all stages but repeated strings, which never compares them with each other; a row that repeats another's
doc_id and text is its near duplicate; null and empty texts fail the quality rules; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from plumbline.llm.common import shared_folder

#: Hundredths from which on two texts are near duplicates.
NEAR = 80


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows that `found` (doc_id, text_key) names; text_key is xxhash64 of the text."""
    found = decontaminate.small(decontaminate.durable(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    # a verdict belongs to a text in its language and source
    judged = quality_rules.apply_rules(docs).filter(~F.col("kept")).select("doc_id", "lang", "source", "text_key").distinct()
    gone = decontaminate.small(decontaminate.durable(judged.select(*[F.col(c).alias(f"_{c}") for c in judged.columns])))
    same = [docs[c].eqNullSafe(gone[f"_{c}"]) for c in ("doc_id", "lang", "source")]
    return docs.join(gone, reduce(Column.__and__, same, F.xxhash64(docs["text"]) == gone["_text_key"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = near_dedup.near_duplicates(docs, NEAR).filter(~F.col("kept")).select("doc_id").distinct()
        return docs.join(decontaminate.small(decontaminate.durable(gone)), "doc_id", "left_anti").select(*docs.columns)
    # rows that share a doc_id: row numbers in the order of doc_id stand for it
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.struct(*docs.columns).alias("row"))
    rows = decontaminate.durable(ordered.withColumn("number", F.monotonically_increasing_id()))
    numbered = rows.select(F.when(F.col("row.doc_id").isNotNull(), F.col("number")).alias("doc_id"), F.col("row.text").alias("text"))
    gone = near_dedup.near_duplicates(numbered, NEAR).filter(~F.col("kept")).select(F.col("doc_id").alias("number")).distinct()
    return rows.join(decontaminate.small(decontaminate.durable(gone)), "number", "left_anti").select("row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long strings that a document with a smaller doc_id has too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = {c: f"_carried_{i}" for i, c in enumerate(others)}
    marked = docs.select("doc_id", "text", *[F.col(c).alias(x) for c, x in carried.items()], F.col("text").isNull().alias("_no_text"))
    out = suffix_dedup.remove_repeats(marked, with_bytes=False, carry=(*carried.values(), "_no_text"))
    made = {c: F.col(x) for c, x in carried.items()} | {"doc_id": F.col("doc_id"), "text": F.when(~F.col("_no_text"), F.col("kept_text"))}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(made["n_chars"])
    return out.select(*[made[c].alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("benchmark leaks", leaks),
    ("packing", packed),
]
#: SQL can express neither the tokenizer nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; what each returns is written to the session's checkpoint folder and read again."""
    folder = shared_folder(spark)
    at = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
