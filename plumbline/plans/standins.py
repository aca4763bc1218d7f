"""The driver's tables in the roles of logs, snapshots, drafts, claims and labels, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("U"), F.col("user_id")).alias("user"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "props")


EVENTS = "ev AS (SELECT *, 'U' || user_id AS \"user\" FROM events)"


def logs(spark: SparkSession, sf_dir: str, grain: str = "day") -> dict[str, DataFrame]:
    """Five logs from the event types: view, error, click, purchase and signup."""
    e = features.prepare(events(spark, sf_dir), grain)
    kind = F.col("event_type")
    even = F.col("event_id") % 2 == 0
    mail = F.concat(F.lit("a@dtaa.com;b@x"), F.col("event_id") % 7, F.lit(".org"))
    return {
        "logon": e.filter(kind == "view").withColumn("activity", F.when(F.col("event_id") % 4 != 0, "Logon").otherwise("Logoff")).withColumn("pc", F.concat(F.lit("PC"), F.col("event_id") % 9)),
        "device": e.filter(kind == "error").withColumn("activity", F.when(even, "Connect").otherwise("Disconnect")),
        "file": e.filter(kind == "click").withColumn("to_removable_media", F.when(even, "True").otherwise("False")).withColumn("filename", F.concat(F.lit("f"), F.col("event_id") % 50, F.lit(".d"), F.col("event_id") % 3)),
        "email": e.filter(kind == "purchase").withColumn("activity", F.when(even, "Send").otherwise("View")).withColumn("to", mail).withColumn("cc", F.lit("c@dtaa.com")).withColumn("bcc", F.lit(None).cast("string"))
        .withColumn("attachments", F.concat(F.lit("r.doc("), F.col("event_id") * 1000, F.lit(");z.zip(10)"))),
        "http": e.filter(kind == "signup").withColumn("url", F.concat(F.lit("http://"), F.element_at(F.array(*map(F.lit, ("www.indeed.com", "dropbox.com", "wikileaks.org", "a.example.org"))), (F.col("event_id") % 4 + 1).cast("int")), F.lit("/p"))),
    }


RAW_FEATURES = (
    EVENTS
    + """,
pe AS (SELECT *, strftime(ts, '%Y-%m-%d') AS period, hour(ts) AS h, hour(ts) < 7 OR hour(ts) >= 19 AS ah, isodow(ts) >= 6 AS we, event_id % 2 = 0 AS even FROM ev),
lo AS (SELECT "user", period, count(*) FILTER (event_id % 4 <> 0) AS total_logons, count(*) FILTER (event_id % 4 <> 0 AND ah) AS after_hours_logons, count(*) FILTER (event_id % 4 <> 0 AND we) AS weekend_logons,
  least(count(DISTINCT event_id % 9), 500) AS distinct_pcs, least(count(DISTINCT ts::DATE), 500) AS n_active_days, count(DISTINCT CASE WHEN we THEN ts::DATE END) AS n_weekend_days,
  min(CASE WHEN event_id % 4 <> 0 THEN h END) AS earliest_hour, max(CASE WHEN event_id % 4 <> 0 THEN h END) AS latest_hour FROM pe WHERE event_type = 'view' GROUP BY 1, 2),
de AS (SELECT "user", period, count(*) FILTER (even) AS total_device_connects, count(*) FILTER (even AND ah) AS after_hours_device_connects FROM pe WHERE event_type = 'error' GROUP BY 1, 2),
fi AS (SELECT "user", period, count(*) AS total_file_events, count(*) FILTER (even) AS removable_media_copies, count(*) FILTER (ah) AS after_hours_file_events,
  least(count(DISTINCT event_id % 50 || '.' || event_id % 3), 500) AS distinct_files, count(DISTINCT event_id % 3) AS distinct_file_exts FROM pe WHERE event_type = 'click' GROUP BY 1, 2),
em AS (SELECT "user", period, count(*) FILTER (even) AS total_emails_sent, 2 * count(*) FILTER (even) AS total_attachments, count(*) FILTER (even) AS external_emails, count(*) FILTER (even) AS external_recipients,
  coalesce(sum(event_id * 1000 + 10) FILTER (even), 0) AS attachment_bytes, count(*) FILTER (even AND ah) AS after_hours_emails FROM pe WHERE event_type = 'purchase' GROUP BY 1, 2),
ht AS (SELECT "user", period, count(*) AS total_http_requests, count(*) FILTER (ah) AS after_hours_http, count(*) FILTER (event_id % 4 = 0) AS job_search_visits, count(*) FILTER (event_id % 4 = 1) AS cloud_storage_visits,
  count(*) FILTER (event_id % 4 = 2) AS leak_site_visits, least(count(DISTINCT event_id % 4), 500) AS distinct_domains FROM pe WHERE event_type = 'signup' GROUP BY 1, 2),
raw AS (SELECT "user", period, """
    + ", ".join(f"{c}::BIGINT AS {c}" if c in features.NULLABLE else f"coalesce({c}, 0)::BIGINT AS {c}" for c in features.FEATURES)
    + """ FROM lo FULL JOIN de USING ("user", period) FULL JOIN fi USING ("user", period) FULL JOIN em USING ("user", period) FULL JOIN ht USING ("user", period))"""
)


def raw_features(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    x = logs(spark, sf_dir, grain)
    wide = features.raw_features(x["logon"], x["device"], x["file"], x["email"], x["http"])
    return wide.select("user", "period", *[F.col(c).cast("long").alias(c) for c in features.FEATURES])


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of two features a supplier and week, a count and a quantity that is none, with the supplier's nation."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    weeks = line.groupBy(F.col("l_suppkey"), F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("w")).agg(F.count("*").cast("double").alias("total_file_events"), F.sum("l_quantity").alias("attachment_bytes"))
    keyed = weeks.join(supplier, weeks.l_suppkey == supplier.s_suppkey).select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("user"), F.date_format("w", "yyyy-MM-dd").alias("period"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("role"), "total_file_events", "attachment_bytes")
    return keyed.unpivot(["user", "period", "role"], ["total_file_events", "attachment_bytes"], "feature", "value")


SUPPLIER_WEEKS = """wk AS (SELECT l_suppkey, strftime(date_trunc('week', l_shipdate), '%Y-%m-%d') AS period, count(*)::DOUBLE AS total_file_events, sum(l_quantity) AS attachment_bytes FROM lineitem GROUP BY 1, 2),
kw AS (SELECT 'S' || l_suppkey AS "user", period, 'N' || s_nationkey AS role, total_file_events, attachment_bytes FROM wk JOIN supplier ON l_suppkey = s_suppkey),
long AS (SELECT "user", period, role, 'total_file_events' AS feature, total_file_events AS value FROM kw UNION ALL SELECT "user", period, role, 'attachment_bytes', attachment_bytes FROM kw)"""

#: After a CTE `long` ("user", period, role, feature, value): scale by feature, self and peer baselines.
BASELINES = """med AS (SELECT feature, median(value) AS m, stddev_pop(value) AS sd FROM long GROUP BY feature),
mads AS (SELECT feature, 1.4826 * median(abs(value - m)) AS mad FROM long JOIN med USING (feature) GROUP BY feature),
scale AS (SELECT feature, CASE WHEN mad > 0 THEN mad ELSE greatest(sd, 1.0) END AS scale FROM med JOIN mads USING (feature)),
hist AS (SELECT *, list(value) OVER (PARTITION BY "user", feature ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h FROM long JOIN scale USING (feature)),
cent AS (SELECT *, CASE WHEN len(h) >= 6 THEN list_aggregate(h, 'median') END AS sc FROM hist),
spre AS (SELECT *, greatest(1.4826 * list_aggregate(list_transform(h, lambda v: abs(v - sc)), 'median'), CASE WHEN feature IN ('earliest_hour', 'latest_hour', 'attachment_bytes') THEN greatest(0.05 * scale, 1e-9) ELSE sqrt(greatest(sc, 1.0)) END) AS ss FROM cent),
self AS (SELECT "user", period, role, feature, value, scale, sc AS self_center, CASE WHEN sc IS NOT NULL THEN ss END AS self_spread, CASE WHEN sc IS NOT NULL THEN greatest(-50.0, least(50.0, (value - sc) / ss)) END AS self_z,
  CASE WHEN sc IS NOT NULL THEN list_max(h) = 0 AND value > 0 END AS self_first, CASE WHEN sc IS NOT NULL THEN list_max(h) END AS self_hist_max FROM spre),
pc AS (SELECT feature, role, period, median(value) AS c, count(*)::INT AS peer_n FROM long GROUP BY ALL),
pm AS (SELECT feature, role, period, any_value(c) AS c, any_value(peer_n) AS peer_n, 1.4826 * median(abs(value - c)) AS mad FROM long JOIN pc USING (feature, role, period) GROUP BY feature, role, period),
both_ AS (SELECT s.*, peer_n, c, greatest(mad, CASE WHEN feature IN ('earliest_hour', 'latest_hour', 'attachment_bytes') THEN greatest(0.05 * scale, 1e-9) ELSE sqrt(greatest(c, 1.0)) END) AS peer_spread FROM self s JOIN pm USING (feature, role, period)),
base AS (SELECT * EXCLUDE (c, scale), CASE WHEN peer_n >= 5 THEN c END AS peer_center, CASE WHEN peer_n >= 5 AND c <> 0 THEN greatest(-50.0, least(50.0, (value - c) / peer_spread)) END AS peer_z FROM both_)"""


def user_roles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("role", F.concat(F.lit("G"), F.substring("user", 2, 20).cast("long") % 3))


def claims_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as claims: cluster_id, user, group, score, label and two more scores."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "hallucinated").when(F.col("quality") == 0, "misweighted").otherwise("grounded")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("cluster_id"), F.col("source").alias("user"), F.col("lang").alias("group"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("score"), label.alias("label"),
        F.least(F.lit(1.0), F.col("n_chars") % 1000 / 1000).alias("self_consistency"), F.when(F.col("n_chars") % 4 != 0, F.least(F.lit(1.0), F.col("n_chars") % 700 / 700)).alias("fact_match"),
        (F.col("n_chars") % 11 == 0).alias("misweighted"), (F.col("n_chars") % 13 == 0).cast("double").alias("hallucinated_context"), (label == "grounded").cast("int").alias("target"),
    )


CLAIMS = """claims AS (SELECT doc_id::VARCHAR AS cluster_id, source AS "user", lang AS "group", least(1.0, n_chars / 5000) AS score, CASE WHEN toxic = 1 THEN 'hallucinated' WHEN quality = 0 THEN 'misweighted' ELSE 'grounded' END AS label,
  least(1.0, n_chars % 1000 / 1000) AS self_consistency, CASE WHEN n_chars % 4 <> 0 THEN least(1.0, n_chars % 700 / 700) END AS fact_match FROM documents JOIN labels USING (doc_id))"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts: signal_id (language and source), sample_index, text."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", "source").alias("signal_id"), F.col("doc_id").alias("sample_index"), F.coalesce("text", F.lit("")).alias("text"))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as sentences of drafts: signal_id (conversation), sample_index (turn), pos, text."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("signal_id"), F.col("turn").alias("sample_index"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return c.filter(F.trim("text") != "").withColumn("sentence_id", F.concat_ws("-", "sample_index", "pos"))


LINES = """turns AS (SELECT conv_id::VARCHAR AS signal_id, turn AS sample_index, string_split(text, chr(10)) AS l FROM conversations),
lines AS (SELECT signal_id, sample_index, i - 1 AS pos, sample_index || '-' || (i - 1) AS sentence_id, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM turns) WHERE trim(l[i]) <> '')"""

