"""Queries of the library's own operators, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import baselines, calibration, evaluation, features, grounding, identity, judgements, pooling, rho, sampling, signals, similarity
from plumbline.plans import standins as T
from plumbline.sources import logs
from plumbline.sources.durable import durable, durable_columns, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(x) -> F.Column:
    return F.round(x, 6)


# ---------------------------------------------------------------- A: scans


def http_line():
    """An event as a line of the http log."""
    return F.concat_ws(",", F.concat(F.lit("{"), F.col("event_id"), F.lit("}")), F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), "user", F.lit("PC-1"), F.concat(F.lit("http://"), F.col("event_type"), F.lit(".com/a")), F.lit("GET"), F.lit('say "a, b, c'))


@query(
    "a1_log_scan",
    """SELECT 'U' || user_id AS "user", 'http://' || event_type || '.com/a' AS url, strftime(ts, '%m/%d/%Y %H:%M:%S') AS date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events""",
)
def a1_log_scan(spark, sf_dir):
    """Lines whose last field holds commas and one quote, split back by position (A1, A2)."""
    e = T.events(spark, sf_dir)
    return logs.parse_lines(e.select(http_line().alias("value")), "http").select("user", "url", "date", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "a6_bounded_scan",
    """SELECT event_id, strftime(ts, '%G-W%V') AS period FROM events WHERE ts < TIMESTAMP '2024-01-21' AND strftime(ts, '%G-W%V') NOT IN ('2024-W02')""",
)
def a6_bounded_scan(spark, sf_dir):
    """Rows before a date, listed periods left out."""
    e = logs.before(features.prepare(T.events(spark, sf_dir)), "2024-01-21")
    return logs.without_periods(e, ["2024-W02"]).select("event_id", "period")


@query(
    "a4_truth_windows",
    """WITH top AS (SELECT user_id, arg_max(ts, value) AS t FROM events GROUP BY user_id HAVING arg_max(event_type, value) = 'purchase')
SELECT 'U' || user_id AS "user", strftime(t, '%Y-%m-%d %H:%M:%S') AS "start", strftime(t + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS "end", 's' || user_id % 3 AS scenario FROM top""",
)
def a4_truth_windows(spark, sf_dir):
    """Answers for users whose greatest value is a purchase, every third with an unreadable date that a fix for (user, raw) mends (A4, A5)."""
    return _windows(spark, sf_dir).select("user", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "scenario")


def _windows(spark, sf_dir):
    first = F.when(F.col("value").isNotNull(), F.struct("value", -F.col("event_id")))  # of equal values the earliest row counts, for time and kind alike
    top = T.events(spark, sf_dir).groupBy("user", "user_id").agg(F.max_by("ts", first).alias("t"), F.max_by("event_type", first).alias("kind")).filter("kind = 'purchase'")
    form = lambda c: F.date_format(c, logs.DATE_FORMAT)
    start, broken = form(F.col("t")), F.concat(F.lit("/21/2011 "), F.col("user"))
    is_broken = F.col("user_id") % 3 == 0
    answers = top.select(F.lit("r6.2").alias("dataset"), "user", F.concat(F.lit("s"), F.col("user_id") % 3).alias("scenario"), F.when(is_broken, broken).otherwise(start).alias("start"), form(F.timestamp_add("DAY", F.lit(3), F.col("t"))).alias("end"))
    fixes = top.filter(is_broken).select("user", broken.alias("raw"), start.alias("fixed"))
    return logs.truth_windows(answers, "r6.2", fixes)


# ---------------------------------------------------------------- B: expressions


@query(
    "b1_event_prep",
    """SELECT event_id, strftime(ts, '%G-W%V') AS period, hour(ts)::INT AS hour, hour(ts) < 7 OR hour(ts) >= 19 AS after_hours, isodow(ts) >= 6 AS weekend,
  strftime(date_trunc('week', ts), '%Y-%m-%d') || ' to ' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS span FROM events""",
)
def b1_event_prep(spark, sf_dir):
    """Week label, hour, working hours, weekend, and the week's days from its label (B1, B2)."""
    return features.prepare(T.events(spark, sf_dir)).select("event_id", "period", "hour", "after_hours", "weekend", S.week_span(F.col("period")).alias("span"))


@query(
    "b3_url_domains",
    """SELECT page_id, string_split(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END, '/')[1] AS domain,
  regexp_matches(lower(url), 'example\\.org|m\\.') AS flagged FROM pages""",
)
def b3_url_domains(spark, sf_dir):
    """Domains and keyword flags of urls."""
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", S.url_domain(F.col("url")).alias("domain"), S.has_keyword(F.col("url"), ("example.org", "m.")).alias("flagged"))


@query(
    "b5_mail_fields",
    """SELECT p_partkey, (p_partkey % 3 + 1)::INT AS outside, 2::INT AS n_attachments, (p_partkey + 10)::BIGINT AS n_bytes, '.t' || p_partkey % 5 AS extension, p_partkey % 2 = 0 AS removable FROM part""",
)
def b5_mail_fields(spark, sf_dir):
    """Recipients outside, attachments and their bytes, extensions, boolean text."""
    k = F.col("p_partkey")
    to = F.concat(F.lit("a@dtaa.com; bad;x@dtaa.com.evil.net"), F.repeat(F.lit(";b@X.org"), (k % 3).cast("int")))
    attached = F.concat(F.lit("report(v2).doc("), k, F.lit(");b.zip(10); "))
    x = T.table(spark, sf_dir, "part").select("p_partkey", to.alias("to"), attached.alias("attached"), F.concat(F.lit("f"), k, F.lit(".a.t"), k % 5).alias("file"), F.when(k % 2 == 0, " TRUE ").otherwise("False").alias("flag"))
    return x.select("p_partkey", S.external_recipients(F.col("to")).alias("outside"), S.attachment_count(F.col("attached")).alias("n_attachments"), S.attachment_bytes(F.col("attached")).alias("n_bytes"), S.file_extension(F.col("file")).alias("extension"), S.is_true_text(F.col("flag")).alias("removable"))


@query(
    "b9_display",
    """SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE '~' END AS shown, substr(sha1(o_custkey || '|' || o_orderstatus), 1, 12) AS short_id,
  CASE WHEN z >= 10 THEN 'far above' WHEN z >= 3 THEN 'clearly above' WHEN z <= -3 THEN 'clearly below' ELSE 'within' END AS phrase FROM (SELECT *, o_orderkey % 40 - 20 AS z FROM orders)""",
)
def b9_display(spark, sf_dir):
    """Shown values, ids and deviation phrases (B9 to B11); decimals are left to unit tests, as engines round differently."""
    o = T.table(spark, sf_dir, "orders")
    shown = S.display(F.lit("total_logons"), F.col("o_totalprice"))
    z = (F.col("o_orderkey") % 40 - 20).cast("double")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") == F.floor("o_totalprice"), shown).otherwise("~").alias("shown"), S.short_id(F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("short_id"), S.deviation_phrase(z, F.lit(False)).alias("phrase"))


@query(
    "b13_text_scalars",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(lower(trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))) AS identity, len(regexp_extract_all(t, '[A-Z]{2,}[0-9]{2,}'))::INT AS n_ids,
  len(list_distinct(regexp_extract_all(lower(t), '[0-9A-Za-z_]+')))::INT AS n_tokens, greatest(1, length(t) // 4)::INT AS approximate_tokens, regexp_matches(lower(t), 'due to|because of|the reason') AS causal FROM t""",
)
def b13_text_scalars(spark, sf_dir):
    """Identity keys, ids in capitals, tokens, causal wording."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select(
        "doc_id", F.md5(S.identity_key(F.col("t")).cast("binary")).alias("identity"), F.size(F.regexp_extract_all("t", F.lit("[A-Z]{2,}[0-9]{2,}"), F.lit(0))).alias("n_ids"), F.size(S.tokens_of(F.col("t"))).alias("n_tokens"),
        S.approximate_tokens(F.col("t")).alias("approximate_tokens"), S.has_causal_language(F.col("t")).alias("causal"),
    )


@query(
    "b14_cosine",
    """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT a, b, round(list_cosine_similarity(x, y), 6) AS cosine FROM p""",
)
def b14_cosine(spark, sf_dir):
    """Cosine of each twentieth vector with all others of its label."""
    e = T.table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    return similarity.cosines(vectors.filter(F.col("id") % 20 == 0), vectors).select("a", "b", r6("cosine").alias("cosine"))


# ---------------------------------------------------------------- C, D: features and joins

query("c_raw_features", f"WITH {T.RAW_FEATURES} SELECT * FROM raw")(T.raw_features)


@query(
    "d2_latest_roles",
    """WITH last AS (SELECT max(strftime(o_orderdate, '%Y-%m')) AS m FROM orders), r AS (SELECT o_custkey, min(o_orderpriority) AS role FROM orders, last WHERE strftime(o_orderdate, '%Y-%m') = m GROUP BY o_custkey)
SELECT c_custkey, coalesce(role, 'UNKNOWN') AS role FROM customer LEFT JOIN r ON c_custkey = o_custkey""",
)
def d2_latest_roles(spark, sf_dir):
    """Role of each customer in the last month's snapshot."""
    roles = identity.latest_roles(_snapshots(spark, sf_dir))
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    return identity.with_roles(rows, roles).select(F.col("user").alias("c_custkey"), "role")


def _snapshots(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("user"), F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_month")).agg(F.min("o_orderpriority").alias("role"))


@query(
    "d4_identity_as_of",
    """WITH s AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS m, min(o_orderpriority) AS role FROM orders GROUP BY 1, 2), grid AS (SELECT c_custkey, unnest(['1994-06', '1997-01']) AS month FROM customer),
j AS (SELECT c_custkey, month, m, role, row_number() OVER (PARTITION BY c_custkey, month ORDER BY m > month, abs(date_diff('month', (m || '-01')::DATE, (month || '-01')::DATE))) AS r FROM grid LEFT JOIN s ON c_custkey = o_custkey)
SELECT c_custkey, month, m AS snapshot_month, coalesce(role, '') AS role FROM j WHERE r = 1""",
)
def d4_identity_as_of(spark, sf_dir):
    """Nearest snapshot not after two probe months, else the nearest after."""
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.explode(F.array(F.lit("1994-06"), F.lit("1997-01"))).alias("month"))
    found = identity.identity_as_of(rows, _snapshots(spark, sf_dir), ("role",))
    return found.select(F.col("user").alias("c_custkey"), "month", "snapshot_month", "role")


_LABELLED = f"""{T.RAW_FEATURES}, top AS (SELECT user_id, arg_max(ts, value) AS t FROM events GROUP BY user_id HAVING arg_max(event_type, value) = 'purchase'),
win AS (SELECT 'U' || user_id AS u, t AS s, t + INTERVAL 3 DAY AS e, 's' || user_id % 3 AS scenario FROM top),
lab AS (SELECT "user", period, total_http_requests > 0 AS is_flagged, u IS NOT NULL AS is_malicious, scenario FROM raw LEFT JOIN win ON "user" = u AND period::TIMESTAMP <= date_trunc('second', e) AND date_trunc('second', s) <= period::TIMESTAMP + INTERVAL 86399 SECOND)"""


@query("d3_label_periods", f'WITH {_LABELLED} SELECT "user", period, is_malicious, scenario FROM lab')
def d3_label_periods(spark, sf_dir):
    """Days of users inside their malicious window (D3)."""
    return _labelled(spark, sf_dir).drop("is_flagged")


def _labelled(spark, sf_dir):
    days = T.raw_features(spark, sf_dir).select("user", "period", (F.col("total_http_requests") > 0).alias("is_flagged"), F.to_timestamp("period").alias("period_start"))
    rows = days.withColumn("period_end", F.timestamp_add("SECOND", F.lit(86399), F.col("period_start")))
    return identity.label_periods(rows, _windows(spark, sf_dir)).drop("period_start", "period_end")


@query(
    "c8_run_summary",
    f"WITH {_LABELLED} SELECT count(*) AS periods, count(*) FILTER (is_flagged) AS flagged, round(count(*) FILTER (is_flagged) / count(*), 6) AS flag_rate, count(*) FILTER (is_malicious) AS malicious, count(*) FILTER (is_malicious AND is_flagged) AS malicious_flagged, round(count(*) FILTER (is_malicious AND is_flagged) / count(*) FILTER (is_malicious), 6) AS recall, count(*) FILTER (is_flagged) / count(*) > 0.05 AS alarm FROM lab",
)
def c8_run_summary(spark, sf_dir):
    s = signals.run_summary(_labelled(spark, sf_dir))
    return s.withColumns({c: r6(F.col(c)) for c in ("flag_rate", "recall")})


@query("d7_set_operations", 'SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders')
def d7_set_operations(spark, sf_dir):
    """Keys in both of two tables."""
    return evaluation.in_both(T.table(spark, sf_dir, "customer").select("c_custkey"), T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("d8_hidden_maxima", "SELECT vec_id, len(list_filter(list_distinct(embedding[1:32]), lambda x: x > 0.1 AND NOT list_contains(embedding[33:64], x)))::INT AS hidden FROM embeddings")
def d8_hidden_maxima(spark, sf_dir):
    """Set difference inside a row."""
    e = T.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size(F.filter(F.array_except(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), lambda x: x.cast("double") > F.lit(0.1).cast("decimal(2,1)"))).alias("hidden"))


# ---------------------------------------------------------------- E, F, G: baselines, rules, signals


@query(
    "e1_self_baselines",
    f'WITH {T.SUPPLIER_WEEKS}, {T.BASELINES} SELECT "user", period, feature, round(self_center, 6) AS self_center, round(self_spread, 4) AS self_spread, round(self_z, 4) AS self_z, self_first, self_hist_max FROM self',
)
def e1_self_baselines(spark, sf_dir):
    """Baselines from each supplier's twelve earlier weeks."""
    b = baselines.self_baselines(T.supplier_weeks(spark, sf_dir))
    return b.select("user", "period", "feature", r6("self_center").alias("self_center"), F.round("self_spread", 4).alias("self_spread"), F.round("self_z", 4).alias("self_z"), "self_first", "self_hist_max")


@query(
    "e6_peer_baselines",
    f'WITH {T.SUPPLIER_WEEKS}, {T.BASELINES} SELECT "user", period, feature, round(peer_center, 6) AS peer_center, round(peer_spread, 4) AS peer_spread, round(peer_z, 4) AS peer_z, peer_n FROM base',
)
def e6_peer_baselines(spark, sf_dir):
    """Baselines of suppliers of one nation in one week; small groups are withheld."""
    b = baselines.peer_baselines(T.supplier_weeks(spark, sf_dir))
    return b.select("user", "period", "feature", r6("peer_center").alias("peer_center"), F.round("peer_spread", 4).alias("peer_spread"), F.round("peer_z", 4).alias("peer_z"), "peer_n")


@query(
    "e7_plain_baselines",
    f"""WITH {T.SUPPLIER_WEEKS}, h AS (SELECT *, avg(value) OVER w AS c, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM long WHERE feature = 'total_file_events' WINDOW w AS (PARTITION BY "user", feature ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT "user", period, CASE WHEN n >= 6 THEN round(c, 6) END AS self_center, CASE WHEN n >= 6 THEN round(greatest(s, sqrt(greatest(c, 1.0))), 4) END AS self_spread FROM h""",
)
def e7_plain_baselines(spark, sf_dir):
    """Mean and standard deviation instead of median and MAD."""
    rows = T.supplier_weeks(spark, sf_dir).filter("feature = 'total_file_events'")
    b = baselines.self_baselines(rows, baselines.BaselineConfig(robust=False))
    return b.select("user", "period", r6("self_center").alias("self_center"), F.round("self_spread", 4).alias("self_spread"))


def baselined_days(spark, sf_dir):
    """The baselines read features several times, so these are kept; logs are aggregated once."""
    return signals.baselined_maps(durable_columns(T.user_roles(T.raw_features(spark, sf_dir))), features.BASELINED)


#: Gates low enough for the stand-in's small counts.
GATES = baselines.BaselineConfig(z_self=1.0, z_peer=1.0)
_FEATURES = [c for c in features.FEATURES if c not in features.WITHOUT_BASELINE]
_DAY_LONG = T.RAW_FEATURES + ", long AS (" + " UNION ALL ".join(f"SELECT \"user\", period, 'G' || substr(\"user\", 2)::BIGINT % 3 AS role, '{c}' AS feature, {c}::DOUBLE AS value FROM raw" for c in _FEATURES) + f"), {T.BASELINES}"
_wide = ", ".join(f"max({m}) FILTER (feature = '{f}') AS {f}_{s}" for f in _FEATURES for m, s in (("value", "v"), ("coalesce(self_z, 0)", "s"), ("coalesce(peer_z, 0)", "p")))
_far = lambda f: f"({f}_s >= 1 AND {f}_p >= 1)"
_FIRED = f"""w AS (SELECT "user", period, {_wide} FROM base GROUP BY "user", period),
fired AS (SELECT "user", period, list_filter([CASE WHEN after_hours_logons_v >= 3 AND after_hours_logons_s >= 1 THEN 'R1' END, CASE WHEN removable_media_copies_v >= 10 AND (removable_media_copies_s >= 1 OR removable_media_copies_p >= 1) THEN 'R2' END,
  CASE WHEN external_recipients_v >= 1 AND attachment_bytes_v >= 50000000 AND attachment_bytes_s >= 1 THEN 'R3' END, CASE WHEN leak_site_visits_v > 0 OR job_search_visits_v >= 5 AND {_far("job_search_visits")} THEN 'R4' END,
  CASE WHEN {" OR ".join(map(_far, signals.VOLUMES))} THEN 'R5' END], lambda x: x IS NOT NULL) AS t FROM w)"""


def flagged_days(spark, sf_dir):
    """Not kept, as most queries read it once, and its rows are large."""
    return signals.apply_rules(baselined_days(spark, sf_dir), config=GATES)


@query("f6_rules", f"WITH {_DAY_LONG}, {_FIRED} SELECT \"user\", period, array_to_string(t, ',') AS triggered, substr(sha1(\"user\" || '|' || period), 1, 12) AS signal_id FROM fired WHERE len(t) > 0")
def f6_rules(spark, sf_dir):
    """User-days where a rule fires: raw features, both baselines, five rules, ids."""
    return flagged_days(spark, sf_dir).select("user", "period", F.array_join("triggered", ",").alias("triggered"), S.short_id(F.col("user"), F.col("period")).alias("signal_id"))


def signal_records(spark, sf_dir):
    return signals.records(signals.facts(flagged_days(spark, sf_dir), config=GATES), period_type="day")


# ---------------------------------------------------------------- H: samples

_ORDER_ROWS = "rows_ AS (SELECT o_orderkey, o_orderpriority, o_orderstatus = 'P' AS bad, md5(o_orderkey || ':20260816') AS k FROM orders)"


@query("h1_uniform_sample", f"WITH {_ORDER_ROWS} SELECT o_orderkey FROM rows_ ORDER BY k, o_orderkey LIMIT 100")
def h1_uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(T.table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")


@query(
    "h2_stratified_sample",
    f"WITH {_ORDER_ROWS}, r AS (SELECT *, CASE WHEN bad THEN 0 ELSE row_number() OVER (PARTITION BY o_orderpriority, bad ORDER BY k, o_orderkey) END AS n FROM rows_) SELECT o_orderkey, o_orderpriority FROM r ORDER BY n, CASE WHEN NOT bad THEN o_orderpriority END NULLS FIRST, o_orderkey LIMIT 1000",
)
def h2_stratified_sample(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("bad"))
    return sampling.stratified_sample(rows, 1000, "o_orderpriority", "bad", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("d5_not_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def d5_not_done(spark, sf_dir):
    """What a finished table, that of customers with an order under way, doesn't have yet."""
    done = T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sampling.not_done(T.table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


# ---------------------------------------------------------------- I, C: pooling

_POOLED = r"""d AS (SELECT lang || '-' || source AS signal_id, doc_id AS sample_index, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT signal_id, sample_index, i - 1 AS pos, l[i] AS text, lower(trim(regexp_replace(l[i], '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS key FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
p AS (SELECT signal_id, key, arg_min(text, (sample_index, pos)) AS text, min((sample_index, pos)) AS first, count(DISTINCT sample_index)::INT AS n_samples FROM s GROUP BY signal_id, key)"""


def _sentences(spark, sf_dir):
    return pooling.sentence_rows(T.drafts(spark, sf_dir), F.split("text", "\n"))


@query("i1_pool_exact", f"WITH {_POOLED} SELECT signal_id, 's' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS sentence_id, md5(text) AS text, n_samples FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY first) AS n FROM p)")
def i1_pool_exact(spark, sf_dir):
    """Lines of documents as sentences, pooled by source and language."""
    return pooling.pool_exact(_sentences(spark, sf_dir)).select("signal_id", "sentence_id", F.md5(F.col("text").cast("binary")).alias("text"), "n_samples")


@query(
    "i2_sentence_ids",
    f"""WITH {_POOLED}, n AS (SELECT signal_id, key, 's' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS sentence_id FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY first) AS n FROM p)),
f AS (SELECT signal_id, sample_index, sentence_id, min(pos) AS pos FROM s JOIN n USING (signal_id, key) GROUP BY ALL)
SELECT signal_id, sample_index, string_agg(sentence_id, ',' ORDER BY pos) AS sentence_ids FROM f GROUP BY ALL""",
)
def i2_sentence_ids(spark, sf_dir):
    """Claims of each draft in order."""
    rows = _sentences(spark, sf_dir)
    found = pooling.sentence_ids(rows, pooling.pool_exact(rows))
    return found.select("signal_id", "sample_index", F.array_join("sentence_ids", ",").alias("sentence_ids"))


@query(
    "c9_distribution",
    f"WITH {_POOLED} SELECT signal_id, count(*) AS claims, count(*) FILTER (n_samples = 1) AS singletons, count(*) FILTER (n_samples >= 2) AS recurring, count(*) FILTER (n_samples >= 6) AS majority, round(count(*) FILTER (n_samples = 1) / count(*), 6) AS singleton_share FROM p GROUP BY signal_id",
)
def c9_distribution(spark, sf_dir):
    d = pooling.distribution(pooling.pool_exact(_sentences(spark, sf_dir)), F.lit(10), ["signal_id"])
    return d.select("signal_id", "claims", "singletons", "recurring", "majority", r6("singleton_share").alias("singleton_share"))


@query("c9_histogram", f"WITH {_POOLED} SELECT n_samples, count(*) AS claims FROM p GROUP BY n_samples")
def c9_histogram(spark, sf_dir):
    return pooling.histogram(pooling.pool_exact(_sentences(spark, sf_dir)))


@query("c10_generator_stats", "SELECT count(DISTINCT lang || '-' || source) AS signals, count(*) AS drafts, count(DISTINCT lower(trim(coalesce(text, ''), ' '))) AS distinct_drafts FROM documents")
def c10_generator_stats(spark, sf_dir):
    return pooling.generator_stats(T.drafts(spark, sf_dir))


@query("c11_pooling_stats", f"WITH {_POOLED} SELECT sum(n_samples)::BIGINT AS mentions, count(*) AS claims, round(sum(n_samples) / count(*), 6) AS compression, count(*) FILTER (n_samples = 1) AS singletons FROM p")
def c11_pooling_stats(spark, sf_dir):
    return pooling.pooling_stats(pooling.pool_exact(_sentences(spark, sf_dir))).withColumn("compression", r6("compression"))


@query(
    "c12_length_comparison",
    "SELECT lang || '-' || source AS signal_id, round(avg(length(coalesce(text, ''))), 4) AS chars, round(avg(greatest(1, length(coalesce(text, '')) // 4)), 4) AS tokens, round(avg(len(string_split(coalesce(text, ''), 'the')) - 1), 4) AS id_mentions FROM documents GROUP BY 1",
)
def c12_length_comparison(spark, sf_dir):
    c = pooling.length_comparison(T.drafts(spark, sf_dir), F.lit("the"), ["signal_id"])
    return c.select("signal_id", *[F.round(x, 4).alias(x) for x in ("chars", "tokens", "id_mentions")])


def _units(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select(F.col("label").alias("signal_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))


def _greedy(thresholds: str) -> str:
    """SQL of greedy clusters, one vector of each label and threshold a step: g(label, t, i, vec_id, heads, cluster)."""
    sims = "list_transform(g.heads, lambda h: list_cosine_similarity(h, v.e))"
    hit = f"list_max({sims}) >= g.t"
    return f"""v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
g(label, t, i, vec_id, heads, cluster) AS (SELECT label, t, i, vec_id, [e], 0::BIGINT FROM v, (SELECT unnest({thresholds}::DOUBLE[]) AS t) WHERE i = 1 UNION ALL
  SELECT g.label, g.t, v.i, v.vec_id, CASE WHEN {hit} THEN g.heads ELSE list_append(g.heads, v.e) END, CASE WHEN {hit} THEN len(g.heads) - list_position(list_reverse({sims}), list_max({sims})) ELSE len(g.heads) END FROM g JOIN v ON v.label = g.label AND v.i = g.i + 1)"""


@query("i3_pool_semantic", f"WITH RECURSIVE {_greedy('[0.3]')} SELECT label AS signal_id, vec_id AS ord, cluster FROM g")
def i3_pool_semantic(spark, sf_dir):
    """Greedy clusters of vectors in order."""
    return pooling.pool_semantic(_units(spark, sf_dir), 0.3)


@query(
    "i5_threshold_sweep",
    f"""WITH RECURSIVE {_greedy('[0.2, 0.3, 0.4]')}, z AS (SELECT t AS threshold, label, cluster, count(*) AS n FROM g GROUP BY ALL)
SELECT threshold, count(*) AS claims, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n >= 2) AS recurring, count(*) FILTER (n >= 6) AS majority, round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_share, round(count(*) FILTER (n >= 2) / count(*), 6) AS recurring_share, round(count(*) FILTER (n >= 6) / count(*), 6) AS majority_share FROM z GROUP BY threshold""",
)
def i5_threshold_sweep(spark, sf_dir):
    """Clusters and singletons at three thresholds."""
    sizes = pooling.threshold_sweep(_units(spark, sf_dir), [0.2, 0.3, 0.4]).groupBy("threshold", "signal_id", "cluster").agg(F.count("*").alias("n_samples"))
    d = pooling.distribution(sizes, F.lit(10), ["threshold"])
    return d.withColumns({c: r6(F.col(c)) for c in ("singleton_share", "recurring_share", "majority_share")})


@query(
    "i4_pool_judged",
    f"WITH {_POOLED}, n AS (SELECT signal_id, key, row_number() OVER (PARTITION BY signal_id ORDER BY key) - 1 AS i FROM p) SELECT signal_id, md5(key) AS key, CASE WHEN i < 3 THEN 'g0' WHEN i < 5 THEN 'g1' ELSE 's' || i END AS cluster FROM n",
)
def i4_pool_judged(spark, sf_dir):
    """Groups made elsewhere: overlapping, and with a place out of range (I4)."""
    from pyspark.sql import Window

    keys = _sentences(spark, sf_dir).select("signal_id", "key").distinct()
    units = keys.withColumn("index", F.row_number().over(Window.partitionBy("signal_id").orderBy("key")) - 1)
    groups = keys.select("signal_id").distinct().withColumn("members", F.expr("array(array(0, 1, 2, 999999999), array(2, 3, 4))"))
    return pooling.judged_clusters(units, groups).select("signal_id", F.md5(F.col("key").cast("binary")).alias("key"), "cluster")


# ---------------------------------------------------------------- J, K: scores

_OVERLAP = """k AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS w FROM lines),
pairs AS (SELECT c.signal_id, c.sentence_id, s.sample_index, len(c.w) > 0 AND len(list_intersect(c.w, s.w)) / len(c.w) >= 0.6 AS hit FROM k c JOIN k s ON c.signal_id = s.signal_id AND c.sample_index <> s.sample_index),
drafts AS (SELECT signal_id, sentence_id, sample_index, bool_or(hit) AS hit FROM pairs GROUP BY ALL)"""


@query("j1_self_consistency", f"WITH {T.LINES}, {_OVERLAP} SELECT signal_id, sentence_id, round(avg(hit::INT), 6) AS self_consistency, count(*) AS n_drafts FROM drafts GROUP BY ALL")
def j1_self_consistency(spark, sf_dir):
    """Lines of a conversation against the lines of its other turns."""
    lines = T.turn_lines(spark, sf_dir)
    claims = lines.select("signal_id", "sentence_id", "text", F.col("sample_index").alias("own"))
    pairs = grounding.claim_pairs(claims.select("signal_id", "sentence_id", "text"), lines, tokens=True)
    outside = pairs.filter(F.col("sample_index") != F.get(F.split("sentence_id", "-"), F.lit(0)).cast("long"))
    return grounding.self_consistency(grounding.judged(outside)).withColumn("self_consistency", r6("self_consistency"))


@query(
    "j2_stored_judgements",
    f"""WITH {T.LINES}, {_OVERLAP.replace("AS hit FROM k c", "AS similar_, c.text AS h, s.text AS p FROM k c").replace("bool_or(hit) AS hit", "bool_or(CASE WHEN length(p) % 3 = 0 THEN length(h) % 2 = 0 ELSE similar_ END) AS hit")} SELECT signal_id, sentence_id, round(avg(hit::INT), 6) AS self_consistency, count(*) AS n_drafts FROM drafts GROUP BY ALL""",
)
def j2_stored_judgements(spark, sf_dir):
    """The same where every third premise has a stored judgement, which counts instead of the overlap."""
    lines = T.turn_lines(spark, sf_dir)
    pairs = grounding.claim_pairs(lines.select("signal_id", "sentence_id", "text"), lines, tokens=True).filter(F.col("sample_index") != F.get(F.split("sentence_id", "-"), F.lit(0)).cast("long"))
    stored = pairs.filter(F.length("premise") % 3 == 0).select(grounding.pair_key().alias("pair_key"), F.when(F.length("hypothesis") % 2 == 0, "entailment").otherwise("neutral").alias("label")).distinct()
    return grounding.self_consistency(grounding.judged(pairs, stored)).withColumn("self_consistency", r6("self_consistency"))


@query(
    "j14_best_siblings",
    f"""WITH {T.LINES}, k AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda x: x NOT IN ({", ".join(repr(x) for x in S.STOP_WORDS)})) AS w FROM lines),
o AS (SELECT c.signal_id, c.sentence_id, s.sample_index, s.text AS premise, CASE WHEN len(c.w) > 0 AND len(s.w) > 0 THEN len(list_intersect(c.w, s.w)) / len(list_distinct(list_concat(c.w, s.w))) ELSE 0 END AS overlap FROM k c JOIN k s ON c.signal_id = s.signal_id AND c.sample_index <> s.sample_index),
b AS (SELECT signal_id, sentence_id, sample_index, max((overlap, premise)) AS b FROM o WHERE overlap >= 0.1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, sentence_id ORDER BY b[1] DESC, sample_index) AS rank FROM b)
SELECT signal_id, sentence_id, sample_index, rank::INT AS rank, b[2] AS premise, round(b[1], 6) AS overlap FROM r WHERE rank <= 3""",
)
def j14_best_siblings(spark, sf_dir):
    """The likeliest sentence of each other turn, ranked (J14, B20); invented lines share few words, so a tenth is enough here."""
    lines = T.turn_lines(spark, sf_dir)
    pairs = grounding.claim_pairs(lines.select("signal_id", "sentence_id", "text"), lines).filter(F.col("sample_index") != F.get(F.split("sentence_id", "-"), F.lit(0)).cast("long"))
    return grounding.best_siblings(pairs, least=0.1).withColumn("overlap", r6("overlap"))


@query("k2_folds", f"""WITH {T.CLAIMS}, c AS (SELECT cluster_id, label = 'grounded' AS target FROM claims) SELECT cluster_id, target::INT AS target, (row_number() OVER (PARTITION BY target ORDER BY md5(cluster_id || ':42'), cluster_id) % 5)::INT AS fold FROM c""")
def k2_folds(spark, sf_dir):
    """Stratified folds (K2)."""
    return rho.with_folds(T.claims_by_label(spark, sf_dir)).select("cluster_id", "target", "fold")


@query(
    "k3_figures",
    f"""WITH {T.CLAIMS}, c AS (SELECT score AS s, (label = 'grounded')::INT AS y FROM claims), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM c)
SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc, round(avg((s - y) ** 2), 6) AS brier, round(avg(abs((s >= 0.5)::INT - y)), 6) AS mae FROM r""",
)
def k3_figures(spark, sf_dir):
    """Exact AUC, Brier score, and error of the class, of a score taken as a probability (K3)."""
    found = rho.probability_figures(T.claims_by_label(spark, sf_dir), score="score")
    return found.select(F.round("auc", 9).alias("auc"), r6("brier").alias("brier"), r6("mae").alias("mae"))


@query(
    "k3_fold_figures",
    f"""WITH {T.CLAIMS}, f AS (SELECT score AS s, (label = 'grounded')::INT AS y, (row_number() OVER (PARTITION BY label = 'grounded' ORDER BY md5(cluster_id || ':42'), cluster_id) % 5) AS fold FROM claims),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2 AS r FROM f),
g AS (SELECT fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, avg((s - y) ** 2) AS brier, avg(abs((s >= 0.5)::INT - y)) AS mae FROM r GROUP BY fold)
SELECT round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, round(avg(brier), 6) AS brier_mean, round(stddev_pop(brier), 6) AS brier_std, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM g""",
)
def k3_fold_figures(spark, sf_dir):
    """The same by fold: means and deviations over five folds (K2, K3)."""
    found = rho.fold_figures(rho.with_folds(T.claims_by_label(spark, sf_dir)), score="score")
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query("k1_rho_model")
def k1_rho_model(spark, sf_dir):
    """Out-of-fold probabilities of the balanced model."""
    scored = rho.cross_validated(T.claims_by_label(spark, sf_dir))
    return scored.select("cluster_id", "target", "rho")


@query("k1_saved_model")
def k1_saved_model(spark, sf_dir):
    """Scores of the model of all claims, written as a record and loaded again."""
    claims, at = T.claims_by_label(spark, sf_dir), f"{_scratch(spark)}/model"
    rho.save_model(spark, rho.train(claims), at)
    return rho.predict(rho.load_model(spark, at), claims).select("cluster_id", "target", "rho")


@query("k3_rho_figures")
def k3_rho_figures(spark, sf_dir):
    """AUC, Brier score, error of the model's out-of-fold probabilities, and their means and deviations over folds (K3)."""
    scored = durable(rho.cross_validated(T.claims_by_label(spark, sf_dir)))
    return rho.probability_figures(scored).join(F.broadcast(rho.fold_figures(scored)))  # a row each


@query(
    "k4_confusion",
    f"""WITH {T.CLAIMS}, c AS (SELECT (label = 'grounded')::INT AS y, (score >= 0.5)::INT AS p FROM claims), k AS (SELECT unnest([0, 1]) AS class)
SELECT class, count(*) FILTER (y = class AND p = class) AS tp, count(*) FILTER (y <> class AND p = class) AS fp, count(*) FILTER (y = class AND p <> class) AS fn, round(count(*) FILTER (y = class AND p = class) / count(*) FILTER (p = class), 6) AS precision FROM c, k GROUP BY class""",
)
def k4_confusion(spark, sf_dir):
    return rho.confusion(T.claims_by_label(spark, sf_dir), score="score").select("class", "tp", "fp", "fn", r6("precision").alias("precision"))


@query(
    "k5_recall_at",
    f"WITH {T.CLAIMS}, r AS (SELECT label, row_number() OVER (ORDER BY score, cluster_id) AS r FROM claims), k AS (SELECT unnest([10, 50, 100, 200, 300, 500]) AS k) SELECT k, count(*) FILTER (label <> 'grounded') AS found, round(count(*) FILTER (label <> 'grounded') / (SELECT count(*) FILTER (label <> 'grounded') FROM claims), 6) AS recall FROM k JOIN r ON r <= k GROUP BY k",
)
def k5_recall_at(spark, sf_dir):
    return rho.recall_at(T.claims_by_label(spark, sf_dir), score="score").withColumn("recall", r6("recall"))


# ---------------------------------------------------------------- L, M: calibration and evaluation

_SPLIT = f"""{T.CLAIMS}, u AS (SELECT "user", min("group") AS g FROM claims GROUP BY "user"), ur AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5("user" || ':42'), "user") AS r, count(*) OVER (PARTITION BY g) AS n FROM u),
split AS (SELECT c.*, r <= ceil(n * 0.5) AS in_calibration FROM claims c JOIN ur USING ("user"))"""
_grid = 'grid AS (SELECT (i * 5 / 100.0)::DOUBLE AS "lambda" FROM (SELECT unnest(range(21)) AS i))'
_CURVE = _grid + """, curve AS (SELECT "lambda", count(*) FILTER (score >= "lambda") AS n_selected, count(*) FILTER (score >= "lambda" AND label IN ('hallucinated', 'misweighted', 'false precision')) AS n_wrong FROM grid, claims GROUP BY "lambda")"""


@query("l1_split", f'WITH {_SPLIT} SELECT cluster_id, "user", in_calibration FROM split')
def l1_split(spark, sf_dir):
    """Users on one side each, by group (L1)."""
    return calibration.split_by_user(T.claims_by_label(spark, sf_dir), group="group").select("cluster_id", "user", "in_calibration")


@query("l2_risk_curve", f'WITH {T.CLAIMS}, {_CURVE} SELECT "lambda", n_selected, n_wrong, round(n_wrong / greatest(n_selected, 1), 6) AS risk FROM curve')
def l2_risk_curve(spark, sf_dir):
    return calibration.risk_curve(T.claims_by_label(spark, sf_dir)).withColumn("risk", r6("risk"))


def _certified(source: str, alphas: str) -> str:
    """SQL of certified thresholds over the rows of `source`: best(alpha, lambda_hat, achieved_risk, n_selected, n_wrong, p_value, status)."""
    term = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(alpha) + (n - k) * ln(1 - alpha))"
    return f"""{_grid}, lc AS (SELECT "lambda", count(*) FILTER (score >= "lambda") AS n, count(*) FILTER (score >= "lambda" AND label IN ('hallucinated', 'misweighted', 'false precision')) AS w FROM grid, {source} GROUP BY "lambda"),
al AS (SELECT unnest({alphas}::DOUBLE[]) AS alpha), tails AS (SELECT alpha, "lambda", n, w, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, w + 1), lambda k: {term}))) END AS p FROM lc, al),
runs AS (SELECT *, bool_and(p <= 0.1) OVER (PARTITION BY alpha ORDER BY "lambda" DESC) AS fine FROM tails),
best AS (SELECT alpha, min("lambda") FILTER (fine) AS lambda_hat, arg_min(w / greatest(n, 1), "lambda") FILTER (fine) AS achieved_risk, arg_min(n, "lambda") FILTER (fine) AS n_selected, arg_min(w, "lambda") FILTER (fine) AS n_wrong, arg_min(p, "lambda") FILTER (fine) AS p_value, CASE WHEN bool_or(fine) THEN 'pass' ELSE 'fail' END AS status FROM runs GROUP BY alpha)"""


_six = "[0.05, 0.1, 0.15, 0.2, 0.25, 0.3]"


@query(
    "l3_learn_then_test",
    f"WITH {_SPLIT}, cal AS (SELECT * FROM split WHERE in_calibration), {_certified('cal', _six)} SELECT alpha, lambda_hat, round(achieved_risk, 6) AS achieved_risk, n_selected, n_wrong, round(p_value, 6) AS p_value, status FROM best",
)
def l3_learn_then_test(spark, sf_dir):
    """Certified thresholds on the calibration side (L3)."""
    split = calibration.split_by_user(T.claims_by_label(spark, sf_dir), group="group")
    found = calibration.learn_then_test(split.filter("in_calibration"))
    return found.withColumns({c: r6(F.col(c)) for c in ("achieved_risk", "p_value")})


@query(
    "l4_conformal_risk",
    f"""WITH {T.CLAIMS}, {_CURVE}, a AS (SELECT i * 5 / 100.0 AS alpha FROM (SELECT unnest(range(1, 7)) AS i)), b AS (SELECT alpha, greatest(1, round_even(alpha * (SELECT count(*) FROM claims) * 0.5, 0))::BIGINT AS bound FROM a)
SELECT alpha::DOUBLE AS alpha, bound, min("lambda") FILTER (n_wrong + 1 <= bound) AS lambda_hat FROM b, curve GROUP BY alpha, bound""",
)
def l4_conformal_risk(spark, sf_dir):
    return calibration.conformal_risk(T.claims_by_label(spark, sf_dir)).select("alpha", "bound", "lambda_hat")


@query(
    "l5_manifest",
    f"""WITH {T.CLAIMS}, {_certified('claims', _six)} SELECT 'primary' AS policy, 0.1::DOUBLE AS delta, 42::INT AS seed, 21::INT AS n_lambdas, 'documents' AS source, alpha, lambda_hat, n_selected, n_wrong, status FROM best""",
)
def l5_manifest(spark, sf_dir):
    """The calibration's record, written as JSON and read again; a row per result."""
    from plumbline.sources import sinks

    m, at = calibration.manifest(T.claims_by_label(spark, sf_dir), {"source": "documents"}), f"{_scratch(spark)}/manifest"
    sinks.write_records(m, at)
    read = logs.read_records(spark, sinks.current(spark, at), m.schema).select("*", F.explode("results").alias("r"))
    return read.select("policy", "delta", "seed", F.size("lambdas").alias("n_lambdas"), F.col("provenance")["source"].alias("source"), "r.alpha", "r.lambda_hat", "r.n_selected", "r.n_wrong", "r.status")


@query(
    "l6_adaptive_thresholds",
    f"""WITH RECURSIVE {T.CLAIMS}, c AS (SELECT "user" AS period, score::DOUBLE AS s, label IN ('hallucinated', 'misweighted', 'false precision') AS wrong FROM claims),
g AS (SELECT period, list((s, wrong)) AS l, row_number() OVER (ORDER BY period) AS i FROM c GROUP BY period),
step(i, period, "lambda", err) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0.9::DOUBLE, 0.1::DOUBLE UNION ALL
  SELECT g.i, g.period, CASE WHEN step.i = 0 THEN step."lambda" ELSE greatest(0.0, least(1.0, step."lambda" + 0.05 * (step.err - 0.1))) END AS lam,
    len(list_filter(g.l, lambda x: x[1] >= CASE WHEN step.i = 0 THEN step."lambda" ELSE greatest(0.0, least(1.0, step."lambda" + 0.05 * (step.err - 0.1))) END AND x[2]))::DOUBLE
    / greatest(len(list_filter(g.l, lambda x: x[1] >= CASE WHEN step.i = 0 THEN step."lambda" ELSE greatest(0.0, least(1.0, step."lambda" + 0.05 * (step.err - 0.1))) END)), 1) FROM step JOIN g ON g.i = step.i + 1)
SELECT period, round("lambda", 6) AS "lambda", round(err, 6) AS err FROM step WHERE i > 0""",
)
def l6_adaptive_thresholds(spark, sf_dir):
    """Lambda from source to source as periods."""
    rows = T.claims_by_label(spark, sf_dir).withColumn("period", F.col("user"))
    return calibration.adaptive_thresholds(rows).select("period", r6("lambda").alias("lambda"), r6("err").alias("err"))


_fig = "count(*) FILTER (score >= {t}) AS accepted, count(*) FILTER (score >= {t} AND label IN ({p})) AS wrong, round(count(*) FILTER (score >= {t} AND label IN ({p})) / greatest(count(*) FILTER (score >= {t}), 1), 6) AS error, round(coalesce(count(*) FILTER (score >= {t} AND label = 'grounded') / nullif(count(*) FILTER (label = 'grounded'), 0), 0), 6) AS recall"
_primary = "'hallucinated', 'misweighted', 'false precision'"


def _rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("error", "recall", "precision") if c in df.columns})


@query("m1_at_threshold", f"WITH {T.CLAIMS} SELECT {_fig.format(t=0.5, p=_primary)} FROM claims")
def m1_at_threshold(spark, sf_dir):
    return _rounded(evaluation.at_threshold(T.claims_by_label(spark, sf_dir), 0.5))


@query("m6_scenarios", f'WITH {T.CLAIMS} SELECT "group", {_fig.format(t=0.2, p=_primary)} FROM claims GROUP BY "group"')
def m6_scenarios(spark, sf_dir):
    """Error and recall by group (M6)."""
    return _rounded(evaluation.at_threshold(T.claims_by_label(spark, sf_dir), 0.2, by=["group"]))


_LONG = "sl AS (SELECT 'score' AS score_name, score, label FROM claims UNION ALL SELECT 'self_consistency', self_consistency, label FROM claims UNION ALL SELECT 'fact_match', fact_match, label FROM claims)"
_THREE = ("score", "self_consistency", "fact_match")


def _three(spark, sf_dir):
    return T.claims_by_label(spark, sf_dir).select("cluster_id", "label", *_THREE)


@query(
    "m3_ablation",
    f"""WITH {T.CLAIMS}, {_LONG}, t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), y AS (SELECT score_name, threshold, coalesce(score >= threshold, false) AS yes, label = 'grounded' AS truth, score IS NULL AS missing FROM sl, t),
c AS (SELECT score_name, threshold, count(*) FILTER (yes AND truth) AS tp, count(*) FILTER (yes AND NOT truth) AS fp, count(*) FILTER (NOT yes AND truth) AS fn, count(*) FILTER (NOT yes AND NOT truth) AS tn, count(*) FILTER (missing) AS null_scores FROM y GROUP BY ALL)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
)
def m3_ablation(spark, sf_dir):
    """Sweeps of three scores (M2, M3)."""
    return _rounded(evaluation.ablation(_three(spark, sf_dir), _THREE))


@query(
    "m4_baseline_table",
    f"WITH {T.CLAIMS}, {_LONG} SELECT score_name, 'fixed' AS cut, 'primary' AS policy, {_fig.format(t=0.8, p=_primary)} FROM sl GROUP BY score_name UNION ALL SELECT score_name, 'fixed', 'secondary', {_fig.format(t=0.8, p=chr(39) + 'hallucinated' + chr(39))} FROM sl GROUP BY score_name",
)
def m4_baseline_table(spark, sf_dir):
    return _rounded(evaluation.baseline_table(_three(spark, sf_dir), _THREE, {"fixed": 0.8}))


@query(
    "m5_ranks_of_wrong",
    f"""WITH {T.CLAIMS}, c AS (SELECT cluster_id AS "case", score AS case_score FROM claims WHERE cluster_id IN ('24', '37', '67'))
SELECT "case", round(case_score, 6) AS case_score, count(g.score) AS above, round(count(g.score) / (SELECT count(*) FROM claims WHERE label = 'grounded'), 6) AS share FROM c LEFT JOIN (SELECT score FROM claims WHERE label = 'grounded') g ON g.score >= case_score GROUP BY ALL""",
)
def m5_ranks_of_wrong(spark, sf_dir):
    """Where three given claims stand among all grounded ones."""
    r = evaluation.ranks_of_wrong(T.claims_by_label(spark, sf_dir), ["24", "37", "67"])
    return r.select("case", r6("case_score").alias("case_score"), "above", r6("share").alias("share"))


_test_error = 'count(*) FILTER (score >= lambda_hat AND label IN (\'hallucinated\', \'misweighted\', \'false precision\'))'


@query(
    "m7_alpha_series",
    f"""WITH {_SPLIT}, cal AS (SELECT * FROM split WHERE in_calibration), {_certified('cal', '[0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]')}
SELECT alpha, lambda_hat, count(*) FILTER (score >= lambda_hat) AS accepted, {_test_error} AS wrong, round({_test_error} / greatest(count(*) FILTER (score >= lambda_hat), 1), 6) AS error, round(coalesce(count(*) FILTER (score >= lambda_hat AND label = 'grounded') / nullif(count(*) FILTER (label = 'grounded'), 0), 0), 6) AS recall
FROM best, (SELECT * FROM split WHERE NOT in_calibration) GROUP BY alpha, lambda_hat""",
)
def m7_alpha_series(spark, sf_dir):
    """Error and recall of the test side at each alpha's threshold (M7)."""
    split = calibration.split_by_user(T.claims_by_label(spark, sf_dir), group="group")
    cuts = calibration.learn_then_test(split.filter("in_calibration"), alphas=tuple(x / 20 for x in range(1, 11)))
    pairs = [F.struct(F.lit(r.alpha).alias("alpha"), F.lit(r.lambda_hat).cast("double").alias("lambda_hat")) for r in cuts.collect()]  # one for each alpha
    test = split.filter(~F.col("in_calibration")).select("*", F.explode(F.array(*pairs)).alias("c")).select("*", "c.*")
    return _rounded(test.groupBy("alpha", "lambda_hat").agg(*evaluation._figures(F.col("score") >= F.col("lambda_hat"), "primary")))


@query("m11_case_report", f"WITH {T.CLAIMS}, k AS (SELECT unnest(['24', '37', '67', 'nowhere']) AS cluster_id) SELECT cluster_id, label, round(score, 6) AS score, round(fact_match, 6) AS fact_match FROM k LEFT JOIN claims USING (cluster_id)")
def m11_case_report(spark, sf_dir):
    """Score rows of named claims, one of which isn't there."""
    cases = spark.createDataFrame([("24",), ("37",), ("67",), ("nowhere",)], "cluster_id string")
    return evaluation.case_report(T.claims_by_label(spark, sf_dir), cases).select("cluster_id", "label", r6("score").alias("score"), r6("fact_match").alias("fact_match"))


@query("c13_score_histogram", f"WITH {T.CLAIMS} SELECT label, least(floor(score * 20), 19)::INT AS bin, count(*) AS n FROM claims GROUP BY ALL")
def c13_score_histogram(spark, sf_dir):
    return evaluation.score_histogram(T.claims_by_label(spark, sf_dir))


@query("d6_context", f"""WITH {T.CLAIMS} SELECT cluster_id || '_s001' AS cluster_id, cluster_id AS signal_id, CASE WHEN cluster_id::BIGINT % 2 = 0 THEN 'R' || cluster_id::BIGINT % 5 ELSE 'Unknown' END AS rules, CASE WHEN cluster_id::BIGINT % 3 = 0 THEN "group" ELSE 'Unknown' END AS "group" FROM claims""")
def d6_context(spark, sf_dir):
    """Key lookups with defaults."""
    c = T.claims_by_label(spark, sf_dir)
    n = F.col("cluster_id").cast("long")
    rows = c.select(S.cluster_id(F.col("cluster_id"), F.lit("s001")).alias("cluster_id"))
    clusters = c.filter(n % 2 == 0).select(S.cluster_id(F.col("cluster_id"), F.lit("s001")).alias("cluster_id"), "user", F.lit("no").alias("malicious"), F.concat(F.lit("R"), n % 5).alias("rules"))
    groups = c.filter(n % 3 == 0).select(F.col("cluster_id").alias("signal_id"), F.lit("p").alias("period"), "group")
    return evaluation.with_context(rows, clusters, groups).select("cluster_id", "signal_id", "rules", "group")


@query(
    "d10_gold_update",
    "SELECT doc_id::VARCHAR AS cluster_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN least(1.0, n_chars / 5000)::DOUBLE END, 0.0) AS fact_match, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS target, doc_id % 2 <> 0 AS drifted FROM labels JOIN documents USING (doc_id)",
)
def d10_gold_update(spark, sf_dir):
    """Fresh features by cluster, and claims whose text has drifted."""
    c = T.claims_by_label(spark, sf_dir)
    n = F.col("cluster_id").cast("long")
    fresh = c.filter(n % 2 == 0).select("cluster_id", "self_consistency", F.col("score").alias("fact_match"), "misweighted", "hallucinated_context")
    gold = evaluation.updated_gold(c.select("cluster_id", "fact_match", S.is_grounded_label(F.col("label")).alias("target")), fresh)
    texts = c.select("cluster_id", F.col("user").alias("text"))
    labelled = c.select("cluster_id", F.when(n % 2 == 0, F.col("user")).otherwise("other").alias("representative_text"))
    drifted = evaluation.text_drift(texts, labelled).select("cluster_id", F.lit(True).alias("drifted"))
    return gold.join(drifted, "cluster_id", "left").select("cluster_id", "fact_match", "target", F.coalesce("drifted", F.lit(False)).alias("drifted"))


@query("d11_errors", f"WITH {T.CLAIMS} SELECT cluster_id, label FROM claims WHERE label <> 'grounded'")
def d11_errors(spark, sf_dir):
    c = T.claims_by_label(spark, sf_dir)
    return evaluation.errors(c.select("cluster_id", "target"), c.select("cluster_id", "label")).select("cluster_id", "label")


@query("d13_disagreements", f"WITH {T.CLAIMS} SELECT cluster_id, round(score, 6) AS score_a, round(fact_match, 6) AS score_b FROM claims WHERE label = 'grounded' AND score >= 0.5 AND fact_match < 0.3 ORDER BY cluster_id LIMIT 20")
def d13_disagreements(spark, sf_dir):
    c = T.claims_by_label(spark, sf_dir)
    d = evaluation.disagreements(c.select("cluster_id", "label", "score"), c.select("cluster_id", F.col("fact_match").alias("score")), 20)
    return d.select("cluster_id", r6("score_a").alias("score_a"), r6("score_b").alias("score_b"))


# ---------------------------------------------------------------- N: judgement tables


@query(
    "n3_scoring_requests",
    f"""WITH {T.LINES}, c AS (SELECT DISTINCT text FROM lines), p AS (SELECT DISTINCT a.text AS p, b.text AS h FROM lines a JOIN lines b ON a.signal_id = b.signal_id AND b.sample_index = a.sample_index + 1)
SELECT sha1('m|' || kind || '|' || text) AS key_sha1, kind FROM c, (SELECT unnest(['weighting', 'numbers']) AS kind) WHERE NOT (kind = 'weighting' AND length(text) % 2 = 0) UNION ALL SELECT sha1('m|entailment|' || p || '|' || h), 'entailment' FROM p""",
)
def n3_scoring_requests(spark, sf_dir):
    """Requests that no stored judgement answers, kind by kind; pairs are lines of a turn and of the next one."""
    all_lines = T.turn_lines(spark, sf_dir)
    lines = all_lines.select("text")
    after = all_lines.select("signal_id", (F.col("sample_index") - 1).alias("sample_index"), F.col("text").alias("hypothesis"))
    pairs = all_lines.select("signal_id", "sample_index", F.col("text").alias("premise")).join(after, ["signal_id", "sample_index"]).select("premise", "hypothesis")
    stored = lines.filter(F.length("text") % 2 == 0).select(judgements.request_key("m", "weighting", F.col("text")).alias("key_sha1"), F.lit("weighting").alias("kind")).distinct()
    return judgements.scoring_requests(pairs, lines, stored, "m").select("key_sha1", "kind")


@query(
    "n5_responses",
    """SELECT sha1(page_id::VARCHAR) AS key_sha1, CASE page_id % 3 WHEN 0 THEN 'entailment' ELSE 'neutral' END AS label FROM pages WHERE page_id % 5 <> 0""",
)
def n5_responses(spark, sf_dir):
    """Answers read back: some broken, some with odd labels."""
    p = T.table(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("page_id").cast("string").cast("binary")).alias("k"))
    answer = F.when(F.col("page_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.when(F.col("page_id") % 3 == 0, "Entailment").otherwise("perhaps").alias("label"))))
    line = F.to_json(F.struct(F.col("k").alias("request_id"), F.struct(F.array(F.struct(F.struct(F.array(F.struct(answer.alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    return judgements.read_responses(p.select(line.alias("value")), p.select(F.col("k").alias("key_sha1"), F.lit("entailment").alias("kind"))).select("key_sha1", "label")


@query(
    "n6_stored_drafts",
    """SELECT c_custkey::VARCHAR AS signal_id, sha1(c_custkey || '|m|v3|0.7000') AS key_sha1, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS n_drafts FROM customer""",
)
def n6_stored_drafts(spark, sf_dir):
    """Drafts found by key; broken entries and misses have none."""
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("signal_id"), F.lit("m").alias("model"), F.lit("v3").alias("prompt_version"), F.lit(0.7).alias("temperature"), "c_custkey")
    key = judgements.draft_key(F.col("signal_id"), F.col("model"), F.col("prompt_version"), F.col("temperature"))
    cache = c.filter("c_custkey % 3 < 2").select(key.alias("key_sha1"), F.when(F.col("c_custkey") % 3 == 0, '["a","b"]').otherwise("[broken").alias("payload"))
    found = judgements.stored_drafts(c.drop("c_custkey"), cache)
    return found.select("signal_id", "key_sha1", F.coalesce(F.size("drafts"), F.lit(0)).alias("n_drafts"))


# ---------------------------------------------------------------- O: streams


def _scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query(
    "o1_weekly_stream",
    """SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS events, count(*) FILTER (hour(ts) < 7 OR hour(ts) >= 19) AS after_hours_events, count(DISTINCT event_type) AS event_types FROM events GROUP BY 1, 2, date_trunc('week', ts) HAVING date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 14 DAY""",
)
def o1_weekly_stream(spark, sf_dir):
    """Weekly features of a file stream, read to its end: weeks come out once the watermark, 14 days behind, has passed them, and leave the
    state (O1)."""
    from plumbline.streaming import events as stream

    schema = T.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = _scratch(spark)
    stream.run_to_end(stream.weekly_counts(source), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("user_id", F.date_format("week_start", "yyyy-MM-dd").alias("week"), "events", "after_hours_events", "event_types")


_STEP = 'greatest(0.0, least(1.0, step."lambda" + 0.05 * (step.err - 0.1)))'


@query(
    "o2_adaptive_stream",
    f"""WITH RECURSIVE {T.CLAIMS}, c AS (SELECT "group" AS k, "user" AS period, score::DOUBLE AS s, label IN ('hallucinated', 'misweighted', 'false precision') AS wrong FROM claims),
g AS (SELECT k, period, list((s, wrong)) AS l, row_number() OVER (PARTITION BY k ORDER BY period) AS i FROM c GROUP BY k, period),
step(k, i, period, "lambda", err) AS (SELECT k, 1::BIGINT, period, 0.9::DOUBLE, len(list_filter(l, lambda x: x[1] >= 0.9 AND x[2]))::DOUBLE / greatest(len(list_filter(l, lambda x: x[1] >= 0.9)), 1) FROM g WHERE i = 1 UNION ALL
  SELECT g.k, g.i, g.period, {_STEP}, len(list_filter(g.l, lambda x: x[1] >= {_STEP} AND x[2]))::DOUBLE / greatest(len(list_filter(g.l, lambda x: x[1] >= {_STEP})), 1) FROM step JOIN g ON g.k = step.k AND g.i = step.i + 1)
SELECT k AS stream_id, period, round("lambda", 6) AS "lambda", round(err, 6) AS err FROM step""",
)
def o2_adaptive_stream(spark, sf_dir):
    """The acceptance threshold of streams of claims, one for each group (O2)."""
    from plumbline.streaming import events as stream

    at = _scratch(spark)
    rows = T.claims_by_label(spark, sf_dir).select(F.col("group").alias("stream_id"), F.col("user").alias("period"), "score", "label")
    # sources as periods, a week each, in the order of their names; a last row without a score ends the last week
    names = rows.select("period").distinct().select("period", (F.lit("2020-01-06").cast("timestamp") + F.make_interval(weeks=F.row_number().over(Window.orderBy("period")))).alias("closes"))
    claims = rows.join(F.broadcast(names), "period").select("stream_id", "period", "closes", "score", "label")  # a row for each source
    end = claims.groupBy().agg(F.max("closes").alias("closes")).select(F.lit("").alias("stream_id"), F.lit("end").alias("period"), (F.col("closes") + F.expr("INTERVAL 30 DAYS")).alias("closes"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"))
    claims.unionByName(end).write.parquet(f"{at}/claims")
    source = spark.readStream.schema(claims.schema).parquet(f"{at}/claims")
    stream.run_to_end(stream.adaptive_threshold(source), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").withColumns({c: r6(F.col(c)) for c in ("lambda", "err")})


# modules that register more of them
from plumbline.plans import record_queries, table_queries, text_queries  # noqa: E402,F401
