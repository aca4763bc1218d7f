"""Deterministic samples: the order is that of an MD5 of id and seed, so it is the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(ident: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed))).cast("binary"))


def uniform_sample(rows: DataFrame, n: int, ident: str = "signal_id", seed: int = 20260816) -> DataFrame:
    """n rows without replacement, all if there are no more; a top-n, so nothing is sorted whole."""
    return rows.orderBy(shuffle_key(F.col(ident), seed), ident).limit(n)


def ranked(rows: DataFrame, by: str, key: str, ident: str, out: str = "rank") -> DataFrame:
    """Adds each row's place from 1 on within `by`, in the order of the hex text in column `key`, then ident. A group is ranked in
    parts, by the key's first three digits, and the parts' sizes are added up, so no task sees a whole group."""
    rows = rows.withColumn("_part", F.substring(key, 1, 3))
    sizes = rows.groupBy(by, "_part").agg(F.count("*").alias("_size"))
    earlier = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), (F.sum("_size").over(Window.partitionBy(by).orderBy("_part")) - F.col("_size")).alias("_before"))  # 4,096 rows a group at most
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(key, ident))
    joined = rows.withColumn("_own", own).join(earlier, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_by", "_p", "_before", "_own")


def stratified_sample(rows: DataFrame, n: int, bucket: str, first: str, ident: str = "signal_id", seed: int = 20260816) -> DataFrame:
    """Rows where `first` holds come first, by id; then rounds over sorted buckets, one of each, shuffled within."""
    sure = rows.filter(F.col(first)).orderBy(ident).limit(n).withColumn("_r", F.lit(0)).withColumn("_b", F.lit(None).cast(dict(rows.dtypes)[bucket]))
    # a bucket's rows beyond n can't be taken: each task hands on its first n at most
    others = rows.filter(~F.coalesce(F.col(first), F.lit(False))).withColumn("_k", shuffle_key(F.col(ident), seed))
    others = others.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy("_k", ident))).filter(F.col("_r") <= n).drop("_k").withColumn("_b", F.col(bucket))
    return sure.unionByName(others).orderBy("_r", "_b", ident).limit(n).drop("_r", "_b")


def not_done(rows: DataFrame, done: DataFrame, ident: str = "signal_id") -> DataFrame:
    return rows.join(done.select(ident), ident, "left_anti")
