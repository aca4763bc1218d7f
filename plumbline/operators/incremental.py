"""Features that later runs add to: mergeable partial aggregates, kept per log and chunk of input.

A chunk is what a run brings, such as a day; its rows may belong to any period. Its partial rows hold sums, least and greatest values, and
of distinct values the hashes (64 bits), DISTINCT_CAP at most: a set that is cut off there counts as the cap in the end, so capped counts stay
exact. A chunk that is added again replaces itself, so a run that was broken off can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.features import DISTINCT_CAP, KEY, LOGS, joined, measures
from plumbline.sources import sinks


def partials(events: DataFrame, log: str, cap: int = DISTINCT_CAP) -> DataFrame:
    """Prepared rows of one log in, a row per (user, period) out, which merge() can add up with others."""
    own = measures(log)
    plain = {"sum": F.sum, "min": F.min, "max": F.max}
    made = events.groupBy(*KEY).agg(F.count("*").alias("_rows"), *[plain[how](value).alias(name) for name, (how, value) in own.items() if how in plain])
    sets = {name: value for name, (how, value) in own.items() if how == "distinct"}
    if not sets:
        return made
    values = events.select(*KEY, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")) for name, value in sets.items()])).alias("v"))
    values = values.select(*KEY, "v.name", F.xxhash64("v.value").alias("hash"), "v.value").filter("value IS NOT NULL").select(*KEY, "name", "hash").distinct()
    first = F.row_number().over(Window.partitionBy(*KEY, "name").orderBy("hash"))  # each task hands on `cap` at most
    kept = values.withColumn("_r", first).filter(F.col("_r") <= cap)
    lists = kept.groupBy(*KEY).agg(*[F.collect_list(F.when(F.col("name") == n, F.col("hash"))).alias(n) for n in sets])
    return made.join(lists, KEY, "left").select(*made.columns, *[F.coalesce(F.col(n), F.array().cast("array<bigint>")).alias(n) for n in sets])


def merged(parts: DataFrame, log: str, cap: int = DISTINCT_CAP) -> DataFrame:
    """Partial rows of any number of chunks in, the log's features out, as log_features gives them for all rows at once."""
    own = measures(log)
    plain = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "min": F.min, "max": F.max}
    made = parts.groupBy(*KEY).agg(*[plain[how](name).alias(name) for name, (how, _) in own.items() if how in plain])
    for name, (how, _) in own.items():
        if how == "distinct":
            count = parts.select(*KEY, F.explode(name).alias("h")).groupBy(*KEY).agg(F.least(F.count_distinct("h"), F.lit(cap)).alias(name))
            made = made.join(count, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return made.select(*KEY, *own)


def add_chunk(logs: dict[str, DataFrame], store: str, chunk: str) -> None:
    """Keeps the partial aggregates of a chunk of prepared logs under store/<log>/<chunk>, replacing those of an earlier try."""
    for log in LOGS:
        sinks.write_records(partials(logs[log], log), f"{store}/{log}/{chunk}", "parquet", empty=True)


def has_chunk(spark: SparkSession, store: str, chunk: str) -> bool:
    return all(sinks.is_written(spark, f"{store}/{log}/{chunk}") for log in LOGS)


def features_of(spark: SparkSession, store: str, chunks: list[str]) -> DataFrame:
    """Features of all these chunks together; their logs aren't read again."""
    read = lambda log: reduce(DataFrame.unionByName, [spark.read.parquet(sinks.current(spark, f"{store}/{log}/{c}")) for c in chunks])
    return joined([merged(read(log), log) for log in LOGS])
