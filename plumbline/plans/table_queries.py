"""Queries of readers, writers, settings and summaries: each writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features, incremental, judgements, pooling
from plumbline.plans import standins as T
from plumbline.plans.queries import _POOLED, _scratch, _sentences, _snapshots, http_line, query, signal_records
from plumbline.plans.record_queries import _FACTS
from plumbline.sources import log_source, logs, sinks


@query("a3_snapshots", "SELECT strftime(o_orderdate, '%Y-%m') AS snapshot_month, count(DISTINCT o_custkey) AS users, min(o_orderpriority) AS least_role FROM orders GROUP BY 1")
def a3_snapshots(spark, sf_dir):
    """Monthly directory snapshots, one folder of files a month."""
    at = f"{_scratch(spark)}/ldap"
    _snapshots(spark, sf_dir).withColumn("month", F.col("snapshot_month")).drop("snapshot_month").repartition("month").write.partitionBy("month").option("header", True).csv(at)
    rows = logs.read_snapshots(spark, at, "*/*.csv")
    return rows.groupBy("snapshot_month").agg(F.count_distinct("user").alias("users"), F.min("role").alias("least_role"))


@query(
    "a1_log_source",
    """SELECT 'U' || user_id AS "user", 'http://' || event_type || '.com/a' AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""",
)
def a1_log_source(spark, sf_dir):
    """A log written in the order of its dates, read between two dates by the source that takes bounds and columns."""
    at = f"{_scratch(spark)}/http"
    e = T.events(spark, sf_dir).repartitionByRange("ts").sortWithinPartitions("ts")
    e.select(http_line().alias("value")).write.text(at)
    rows = log_source.scan_log(spark, at, "http", ["user", "url", "ts"], ordered=True)
    rows = logs.before(rows, "2024-01-21").filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp"))
    return rows.select("user", "url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("a7_first_rows", "SELECT event_type, least(count(*), 50) AS n FROM events GROUP BY event_type")
def a7_first_rows(spark, sf_dir):
    """At most 50 rows of each log."""
    e = T.table(spark, sf_dir, "events")
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect())  # a handful
    parts = [logs.first_rows(e.filter(F.col("event_type") == k), 50) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a9_signal_records", f"""WITH {_FACTS} SELECT signal_id, count(*)::INT AS n_facts, round(sum(value), 4) AS total, count(*) FILTER (triggering_rule_ids <> '')::INT AS n_evidence FROM facts GROUP BY signal_id""")
def a9_signal_records(spark, sf_dir):
    """Signal records as JSON lines under a path that names the pooling, read with their schema."""
    at = sinks.output_path(_scratch(spark), "semantic", 0.85)
    sinks.write_records(signal_records(spark, sf_dir), at, max_rows=100)
    read = logs.read_records(spark, sinks.current(spark, at), logs.SIGNAL)
    total = F.aggregate("facts", F.lit(0.0), lambda s, f: s + f["value"])
    evidence = F.size(F.filter("facts", lambda f: F.size(f["triggering_rule_ids"]) > 0))
    return read.select("signal_id", F.size("facts").alias("n_facts"), F.round(total, 4).alias("total"), evidence.alias("n_evidence"))


@query("a10_labels", "SELECT doc_id, quality, toxic FROM labels")
def a10_labels(spark, sf_dir):
    """A label CSV with a byte-order mark (A10)."""
    at = f"{_scratch(spark)}/labels.csv"
    lab = T.table(spark, sf_dir, "labels")
    kinds = {f.name: f.dataType for f in lab.schema.fields}
    marked = lab.select(F.col("doc_id").alias("﻿doc_id"), "quality", "toxic")  # each file of it begins with the mark
    sinks.write_records(marked, at, "csv")
    return logs.read_labels(spark, sinks.current(spark, at)).select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("doc_id", "quality", "toxic")])


@query("a13_guarded_output", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a13_guarded_output(spark, sf_dir):
    """An output that an empty result doesn't replace."""
    at = f"{_scratch(spark)}/counts"
    counts = T.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.write_records(counts, at, "parquet")
    try:
        sinks.write_records(counts.filter("n < 0"), at, "parquet")
    except ValueError:
        return spark.read.parquet(sinks.current(spark, at))
    raise AssertionError("an empty result has replaced a good one")


@query("a14_resumed", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a14_resumed(spark, sf_dir):
    """A finished step is read, not built again."""
    at = f"{_scratch(spark)}/step"
    counts = T.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sinks.resumed(spark, at, lambda: counts)
    return sinks.resumed(spark, at, lambda: counts.filter("n < 0"))


@query("a14_incremental", f"WITH {T.RAW_FEATURES} SELECT * FROM raw")
def a14_incremental(spark, sf_dir):
    """Features of two runs, mornings and then afternoons, from their kept partial aggregates; the first is repeated."""
    at, x = f"{_scratch(spark)}/partials", T.logs(spark, sf_dir, "day")
    runs = {"mornings": F.col("hour") < 12, "afternoons": F.col("hour") >= 12}
    for chunk in ("mornings", "mornings", "afternoons"):
        incremental.add_chunk({log: events.filter(runs[chunk]) for log, events in x.items()}, at, chunk)
    wide = incremental.features_of(spark, at, list(runs))
    return wide.select("user", "period", *[F.col(c).cast("long").alias(c) for c in features.FEATURES])


@query("a15_settings", "SELECT 'm' AS model, max(turn) + 1 AS k, 0.7::DOUBLE AS temperature, 0.85::DOUBLE AS threshold, 'v3' AS prompt_version FROM conversations")
def a15_settings(spark, sf_dir):
    """The one set of settings that all narratives of a run share, from their JSON lines."""
    c = T.table(spark, sf_dir, "conversations")
    k = c.agg((F.max("turn") + 1).cast("int").alias("k"))
    told = c.groupBy(F.col("conv_id").cast("string").alias("signal_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("sample_index"), "text"))).alias("narratives"))
    pooled = F.struct(F.lit("semantic").alias("method"), F.lit(0.85).alias("threshold"))
    rows = told.join(F.broadcast(k)).select("signal_id", F.lit("m").alias("model"), F.lit("v3").alias("prompt_version"), F.lit(0.7).alias("temperature"), pooled.alias("pooling"), "k", "narratives")
    at = f"{_scratch(spark)}/narratives"
    sinks.write_records(rows, at)
    found = logs.generation_settings(logs.read_records(spark, sinks.current(spark, at), logs.NARRATIVE))
    return found.select("model", F.col("k").cast("long").alias("k"), "temperature", "threshold", "prompt_version")


@query(
    "c14_generation_summary",
    f"""WITH {_POOLED}, q AS (SELECT lang || '-' || source AS signal_id, bool_or(coalesce(toxic, 0) = 1) AS bad, bool_or(n_chars > 2000) AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1), g AS (SELECT signal_id FROM q WHERE ok)
SELECT (SELECT count(*) FROM q) AS signals_requested, (SELECT count(*) FROM g) AS signals_succeeded, (SELECT count(*) FROM q WHERE ok AND bad) AS malicious_signals, count(*) AS unique_sentences FROM p JOIN g USING (signal_id)""",
)
def c14_generation_summary(spark, sf_dir):
    """Signals asked for, done and malicious, and unique sentences (C14); a signal is done where it has a long draft."""
    d, lab = T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    signal = F.concat_ws("-", "lang", "source").alias("signal_id")
    asked = d.join(lab, "doc_id", "left").groupBy(signal).agg(F.bool_or(F.coalesce("toxic", F.lit(0)) == 1).alias("is_malicious"))
    done = d.filter("n_chars > 2000").select(signal).distinct()
    rows = _sentences(spark, sf_dir).join(done, "signal_id", "left_semi")
    return pooling.generation_summary(asked, T.drafts(spark, sf_dir).join(done, "signal_id", "left_semi"), pooling.pool_exact(rows))


@query("i6_first_drafts", f"WITH {T.LINES} SELECT signal_id, count(*) AS n_sentences, count(DISTINCT sample_index) AS n_drafts FROM lines WHERE sample_index < 3 GROUP BY signal_id")
def i6_first_drafts(spark, sf_dir):
    """Settings that are checked, and drafts beyond the k-th left out."""
    for bad in (("semantic", None, 0.7, 3), ("exact", 0.85, 0.7, 3), ("exact", None, 0.0, 3), ("exact", None, 0.7, 0), ("other", None, 0.7, 3)):
        try:
            pooling.check_settings(*bad)
        except ValueError:
            continue
        raise AssertionError(f"settings {bad} should not pass")
    pooling.check_settings("exact", None, 0.7, 3)
    lines = pooling.first_drafts(T.turn_lines(spark, sf_dir), 3)
    return lines.groupBy("signal_id").agg(F.count("*").alias("n_sentences"), F.count_distinct("sample_index").alias("n_drafts"))


@query("n4_chunks", "SELECT count(*) AS n, ceil(count(*) / 700)::BIGINT AS n_chunks FROM orders")
def n4_chunks(spark, sf_dir):
    """Requests in named chunks of about 700; together they hold every request once."""
    keys = T.table(spark, sf_dir, "orders").select(F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("key_sha1"))
    return judgements.chunk_of(keys, 700).agg(F.count("*").alias("n"), (F.max("chunk") + 1).cast("long").alias("n_chunks"))
