"""Raw features by user and period, from five activity logs.

Each log is aggregated once (partial and final sums are Spark's own), the five results are joined by (user, period), and
features become long rows (user, period, feature, value) for baselines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S

KEY = ["user", "period"]
DISTINCT_CAP = 500
# The features in their order, and those that get no baseline.
FEATURES = (
    "total_logons", "after_hours_logons", "weekend_logons", "distinct_pcs", "n_active_days", "n_weekend_days", "earliest_hour", "latest_hour", "total_device_connects",
    "after_hours_device_connects", "total_file_events", "removable_media_copies", "after_hours_file_events", "distinct_files", "distinct_file_exts", "total_emails_sent",
    "total_attachments", "external_emails", "external_recipients", "attachment_bytes", "after_hours_emails", "total_http_requests", "after_hours_http", "job_search_visits",
    "cloud_storage_visits", "leak_site_visits", "distinct_domains",
)
WITHOUT_BASELINE = ("earliest_hour", "latest_hour", "distinct_file_exts", "total_attachments")
BASELINED = tuple(c for c in FEATURES if c not in WITHOUT_BASELINE)
NULLABLE = ("earliest_hour", "latest_hour")


def prepare(events: DataFrame, grain: str = "week") -> DataFrame:
    """Adds period (ISO week, or day), hour, after_hours and weekend to rows with user and ts."""
    period = S.iso_week(F.col("ts")) if grain == "week" else F.date_format("ts", "yyyy-MM-dd")
    return events.withColumns({"period": period, "hour": F.hour("ts"), "after_hours": S.after_hours(F.col("ts")), "weekend": S.on_weekend(F.col("ts"))})


def capped_distinct(value: Column, cap: int = DISTINCT_CAP, approximate: bool = False) -> Column:
    """Number of distinct values, `cap` at most. The approximate form keeps a fixed-size sketch per key."""
    return F.least(F.approx_count_distinct(value) if approximate else F.count_distinct(value), F.lit(cap))


def measures(log: str) -> dict[str, tuple[str, Column]]:
    """The measures of a log: name, how rows combine (sum, min, max, distinct), and a row's value; null counts as nothing."""
    one = lambda on=F.lit(True): F.when(on, 1)
    if log == "logon":  # log-offs count for machines and active days, not for logons or hours
        on, day = F.col("activity") == "Logon", F.to_date("ts")
        return {
            "total_logons": ("sum", one(on)), "after_hours_logons": ("sum", one(on & F.col("after_hours"))), "weekend_logons": ("sum", one(on & F.col("weekend"))),
            "distinct_pcs": ("distinct", F.col("pc")), "n_active_days": ("distinct", day), "n_weekend_days": ("distinct", F.when(F.col("weekend"), day)),
            "earliest_hour": ("min", F.when(on, F.col("hour"))), "latest_hour": ("max", F.when(on, F.col("hour"))),
        }
    if log == "device":
        connect = F.col("activity") == "Connect"
        return {"total_device_connects": ("sum", one(connect)), "after_hours_device_connects": ("sum", one(connect & F.col("after_hours")))}
    if log == "file":
        return {
            "total_file_events": ("sum", one()), "removable_media_copies": ("sum", one(S.is_true_text(F.col("to_removable_media")))), "after_hours_file_events": ("sum", one(F.col("after_hours"))),
            "distinct_files": ("distinct", F.col("filename")), "distinct_file_exts": ("distinct", S.file_extension(F.col("filename"))),
        }
    if log == "email":  # what isn't sent only gives the user a row
        sent, outside = F.col("activity") == "Send", sum(S.external_recipients(F.col(c)) for c in ("to", "cc", "bcc"))
        return {
            "total_emails_sent": ("sum", one(sent)), "total_attachments": ("sum", F.when(sent, S.attachment_count(F.col("attachments")))), "external_emails": ("sum", one(sent & (outside > 0))),
            "external_recipients": ("sum", F.when(sent, outside)), "attachment_bytes": ("sum", F.when(sent, S.attachment_bytes(F.col("attachments")))), "after_hours_emails": ("sum", one(sent & F.col("after_hours"))),
        }
    if log == "http":
        domain = S.url_domain(F.col("url"))
        visit = lambda words: one(S.has_keyword(domain, words))
        return {
            "total_http_requests": ("sum", one()), "after_hours_http": ("sum", one(F.col("after_hours"))), "job_search_visits": ("sum", visit(S.JOB_SEARCH)),
            "cloud_storage_visits": ("sum", visit(S.CLOUD_STORAGE)), "leak_site_visits": ("sum", visit(S.LEAK_SITES)), "distinct_domains": ("distinct", domain),
        }
    raise ValueError(f"no log is named {log}")


LOGS = ("logon", "device", "file", "email", "http")


def log_features(events: DataFrame, log: str) -> DataFrame:
    """Prepared rows of one log in, a row per (user, period) out."""
    made = {"sum": lambda v: F.coalesce(F.sum(v), F.lit(0)), "min": F.min, "max": F.max, "distinct": capped_distinct}
    return events.groupBy(*KEY).agg(*[made[how](value).alias(name) for name, (how, value) in measures(log).items()])


def joined(parts: list[DataFrame]) -> DataFrame:
    """Features of the logs, one wide row per (user, period): zero where a log has nothing, but null hours; no negative count. Logs meet in one
    aggregation, as a full join with each would shuffle the wide rows again; rows with a null in their key meet none, as in a join."""
    alone = lambda i: F.when(F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull(), F.lit(i))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_alone", alone(i)) for i, p in enumerate(parts)])
    wide = every.groupBy(*KEY, "_alone").agg(*[F.max(c).alias(c) for c in every.columns if c not in (*KEY, "_alone")])

    # a check in each column, not one filter over all: the optimizer's inferences from such a filter double with every column where a log is empty
    def count(c: str) -> Column:
        n = F.coalesce(c, F.lit(0)).cast("long")
        return F.when(n >= 0, n).otherwise(F.raise_error(F.lit("a count is negative")).cast("long")).alias(c)

    return wide.select(*KEY, *[F.col(c) if c in NULLABLE else count(c) for c in FEATURES])


def raw_features(logon: DataFrame, device: DataFrame, file: DataFrame, email: DataFrame, http: DataFrame) -> DataFrame:
    """Prepared logs in, one wide row per (user, period) out."""
    return joined([log_features(events, log) for log, events in zip(LOGS, (logon, device, file, email, http))])


def long_features(wide: DataFrame, features: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (user, period, feature, value) of the features that get baselines."""
    names = features or BASELINED
    return wide.select(*KEY, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(KEY, list(names), "feature", "value")
