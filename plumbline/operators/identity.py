"""Who a user is in a month, and whether a period is marked malicious."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S

IDENTITY = ("employee_name", "role", "business_unit", "functional_unit", "department", "team", "supervisor")
UNKNOWN = "UNKNOWN"


def latest_roles(snapshots: DataFrame, role: str = "role") -> DataFrame:
    """user and role of the last month's snapshot."""
    last = snapshots.agg(F.max("snapshot_month").alias("snapshot_month"))
    return snapshots.join(F.broadcast(last), "snapshot_month").select("user", F.col(role).alias("role")).dropDuplicates(["user"])


def with_roles(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds role; users without one form a group of their own."""
    return rows.join(roles, "user", "left").withColumn("role", F.coalesce("role", F.lit(UNKNOWN)))


def identity_as_of(rows: DataFrame, snapshots: DataFrame, columns: tuple[str, ...] = IDENTITY) -> DataFrame:
    """rows: user, month. Adds the identity columns of the nearest snapshot month not after it that has the user, else of the
    nearest after it, else blanks. The choice is an aggregate, so each user's months are never sorted or gathered."""
    s = snapshots.select("user", "snapshot_month", *columns)
    keys = rows.select("user", "month").distinct().join(s, "user")
    order = F.struct((F.col("snapshot_month") > F.col("month")).alias("later"), F.abs(F.months_between(F.to_date(F.concat("snapshot_month", F.lit("-01"))), F.to_date(F.concat("month", F.lit("-01"))))).alias("apart"))
    picked = keys.groupBy("user", "month").agg(F.min_by(F.struct("snapshot_month", *columns), order).alias("p"))
    out = rows.join(picked, ["user", "month"], "left")
    return out.select(*rows.columns, F.col("p.snapshot_month").alias("snapshot_month"), *[S.clean_identity(F.col(f"p.{c}")).alias(c) for c in columns])


def label_periods(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows: user, period, period_start, period_end. Malicious when the user's window (start, end) overlaps the period, edges
    included; scenario of the window."""
    w = windows.select(F.col("user").alias("_u"), F.col("start").alias("_s"), F.col("end").alias("_e"), "scenario")
    hit = rows.join(w, (F.col("user") == F.col("_u")) & (F.col("period_start") <= F.col("_e")) & (F.col("_s") <= F.col("period_end")), "left")
    one = hit.withColumn("_r", F.row_number().over(Window.partitionBy(*rows.columns).orderBy("_s"))).filter("_r = 1")
    return one.select(*rows.columns, F.col("_u").isNotNull().alias("is_malicious"), "scenario")
