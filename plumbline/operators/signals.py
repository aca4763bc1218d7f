"""Rules over baselines, and the signal records of flagged periods.

Rules read one map per (user, period): feature -> value and baselines. A rule is a predicate and the fields that are
evidence when it fires; new rules are added by passing another list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import baselines, features
from plumbline.operators.baselines import BaselineConfig

MEASURES = ("value", "self_center", "self_z", "self_first", "self_hist_max", "peer_center", "peer_z", "peer_n")
ALWAYS = ("distinct_pcs", "n_active_days", "earliest_hour", "latest_hour")


def value(field: str) -> Column:
    return F.coalesce(F.try_element_at("stats", F.lit(field))["value"], F.lit(0.0))


def z(field: str, side: str) -> Column:
    """A z that is missing acts as 0."""
    return S.z_or_zero(F.try_element_at("stats", F.lit(field))[f"{side}_z"])


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    description: str
    fields: tuple[str, ...]
    fires: Callable[[BaselineConfig], Column]
    evidence: Callable[[BaselineConfig], Column]


def fixed(*fields: str) -> Callable[[BaselineConfig], Column]:
    return lambda config: F.array(*[F.lit(f) for f in fields])


VOLUMES = ("total_logons", "total_file_events", "total_http_requests", "total_device_connects")


def _far(field: str, c: BaselineConfig) -> Column:
    return (z(field, "self") >= c.z_self) & (z(field, "peer") >= c.z_peer)


def _job_search(c: BaselineConfig) -> Column:
    return (value("job_search_visits") >= 5) & _far("job_search_visits", c)


RULES = (
    Rule("R1", "After-hours spike", "Many more logons outside working hours than usual", ("after_hours_logons", "total_logons", "weekend_logons", "n_active_days"),
         lambda c: (value("after_hours_logons") >= 3) & (z("after_hours_logons", "self") >= c.z_self), fixed("after_hours_logons")),
    Rule("R2", "Removable media", "Many copies to removable media", ("removable_media_copies", "total_device_connects", "after_hours_device_connects", "total_file_events"),
         lambda c: (value("removable_media_copies") >= 10) & ((z("removable_media_copies", "self") >= c.z_self) | (z("removable_media_copies", "peer") >= c.z_peer)), fixed("removable_media_copies")),
    Rule("R3", "External mail volume", "Large attachments sent outside", ("attachment_bytes", "external_recipients", "external_emails", "total_emails_sent"),
         lambda c: (value("external_recipients") >= 1) & (value("attachment_bytes") >= 50_000_000) & (z("attachment_bytes", "self") >= c.z_self), fixed("attachment_bytes", "external_recipients")),
    Rule("R4", "Off-role browsing", "Leak sites, or far more job search than usual", ("job_search_visits", "leak_site_visits", "cloud_storage_visits", "distinct_domains"),
         lambda c: (value("leak_site_visits") > 0) | _job_search(c),
         lambda c: F.array_compact(F.array(F.when(value("leak_site_visits") > 0, F.lit("leak_site_visits")), F.when(_job_search(c), F.lit("job_search_visits"))))),
    Rule("R5", "Peer deviation", "A volume far from both own history and peers", VOLUMES,
         lambda c: _far(VOLUMES[0], c) | _far(VOLUMES[1], c) | _far(VOLUMES[2], c) | _far(VOLUMES[3], c),
         lambda c: F.array_compact(F.array(*[F.when(_far(f, c), F.lit(f)) for f in VOLUMES]))),
)


def stat_maps(baselined: DataFrame, keys: tuple[str, ...] = ("user", "period")) -> DataFrame:
    """One row per (user, period) with stats: feature -> struct of MEASURES."""
    entry = F.struct("feature", F.struct(*MEASURES).alias("s"))
    return baselined.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("stats"))


def baselined_maps(wide: DataFrame, names: tuple[str, ...], config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Rows user, period and stats with the baselines of the named features of wide: user, period, role and a column per feature, kept durably."""
    if config.robust:
        return baselines.wide_stats(wide.select(*features.KEY, "role", *names), names, config).drop("role")
    long = wide.select(*features.KEY, "role", *[F.col(c).cast("double").alias(c) for c in names]).unpivot([*features.KEY, "role"], list(names), "feature", "value")
    return stat_maps(baselines.baselines(long, config))


def apply_rules(maps: DataFrame, rules: tuple[Rule, ...] = RULES, config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Rows where a rule fires, with triggered (ids in rule order) and evidence (rule_id, fields)."""
    fired = F.array_compact(F.array(*[F.when(r.fires(config), F.struct(F.lit(r.rule_id).alias("rule_id"), r.evidence(config).alias("fields"))) for r in rules]))
    # conditions alone are compiled code, which the arrays are not; few rows are left for those
    found = maps.filter(reduce(or_, [r.fires(config) for r in rules], F.lit(False))).withColumn("evidence", fired)
    return found.withColumn("triggered", F.transform("evidence", lambda e: e["rule_id"]))


def evidence_map(evidence: Column) -> Column:
    """Field -> ids of the rules it is evidence for."""
    fields = F.array_distinct(F.flatten(F.transform(evidence, lambda e: e["fields"])))
    ids = lambda f: F.transform(F.filter(evidence, lambda e: F.array_contains(e["fields"], f)), lambda e: e["rule_id"])
    return F.map_from_arrays(fields, F.transform(fields, ids))


def gloss(field: Column) -> Column:
    """A feature's name in words."""
    return F.replace(field, F.lit("_"), F.lit(" "))


def facts(flagged: DataFrame, rules: tuple[Rule, ...] = RULES, config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Adds facts: evidence first, then the other fields of fired rules in rule order, then ALWAYS; F001 on, at most max_facts."""
    context = F.array_compact(F.array(*[F.when(F.array_contains("triggered", r.rule_id), F.lit(f)) for r in rules for f in r.fields], *[F.lit(f) for f in ALWAYS]))
    wanted = F.array_distinct(F.concat(F.map_keys("by_field"), context))
    # each field is looked up once
    known = F.filter(F.transform(wanted, lambda f: F.struct(f.alias("f"), F.try_element_at(F.col("stats"), f).alias("s"))), lambda x: x["s"].isNotNull())

    def fact(x: Column, i: Column) -> Column:
        f, s = x["f"], x["s"]
        has_self, has_peer = s["self_z"].isNotNull(), s["peer_z"].isNotNull()
        return F.struct(
            F.format_string("F%03d", i + 1).alias("fact_id"),
            f.alias("field"),
            s["value"].alias("value"),
            S.display(f, s["value"]).alias("display"),
            gloss(f).alias("gloss"),
            F.coalesce(F.try_element_at(F.col("by_field"), f), F.array().cast("array<string>")).alias("triggering_rule_ids"),
            F.when(has_self, F.round(s["self_center"], 3)).alias("self_center"),
            F.round(s["self_z"], 2).alias("self_z"),
            F.when(has_self, F.abs(s["self_z"]) >= config.z_cap).alias("self_z_capped"),
            F.when(has_self, s["self_hist_max"]).alias("self_recent_max"),
            F.when(has_self, s["self_first"]).alias("never_before"),
            F.when(has_peer, F.round(s["peer_center"], 3)).alias("peer_center"),
            F.round(s["peer_z"], 2).alias("peer_z"),
            F.when(has_peer, F.abs(s["peer_z"]) >= config.z_cap).alias("peer_z_capped"),
            F.when(has_peer, s["peer_n"].cast("int")).alias("peer_group_size"),
        )

    return flagged.withColumn("by_field", evidence_map(F.col("evidence"))).withColumn("_f", F.slice(known, 1, config.max_facts)).withColumn("facts", F.transform("_f", fact)).drop("_f", "by_field")


def records(with_facts: DataFrame, rules: tuple[Rule, ...] = RULES, period_type: str = "week") -> DataFrame:
    """Signal records; identity, is_malicious and scenario are used where the rows have them."""
    has = set(with_facts.columns)
    rule_structs = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.description).alias("description")) for r in rules])
    return with_facts.select(
        S.short_id(F.col("user").cast("string"), F.col("period")).alias("signal_id"),
        F.col("user").cast("string").alias("user"),
        "period",
        F.lit(period_type).alias("period_type"),
        (F.col("identity") if "identity" in has else F.lit(None).cast("struct<role:string>")).alias("identity"),
        F.filter(rule_structs, lambda r: F.array_contains(F.col("triggered"), r["rule_id"])).alias("triggered_rules"),
        "facts",
        F.struct((F.col("is_malicious") if "is_malicious" in has else F.lit(False)).alias("is_malicious"), (F.col("scenario") if "scenario" in has else F.lit(None).cast("string")).alias("scenario")).alias("label"),
    )


def evidence_ids(all_facts: Column) -> Column:
    return F.transform(F.filter(all_facts, lambda f: F.size(f["triggering_rule_ids"]) > 0), lambda f: f["fact_id"])


def context_text(signals: DataFrame) -> DataFrame:
    """signal_id and the text that describes a signal: identity, period, rules, evidence, context. Recent maxima and z values
    stay out; what never happened before has no `own typical` clause."""

    def line(f: Column) -> Column:
        own = F.when(f["never_before"], F.lit("; never before for this user")).when(f["self_center"].isNotNull(), F.concat(F.lit("; own typical "), F.format_string("%.2f", f["self_center"]), F.lit(", "), S.deviation_phrase(f["self_z"], f["self_z_capped"])))
        peers = F.when(f["peer_center"].isNotNull(), F.concat(F.lit("; peer typical "), F.format_string("%.2f", f["peer_center"]), F.lit(" among "), f["peer_group_size"].cast("string"), F.lit(", "), S.deviation_phrase(f["peer_z"], f["peer_z_capped"])))
        return F.concat(F.lit("- "), f["fact_id"], F.lit(" "), f["gloss"], F.lit(": "), f["display"], F.coalesce(own, F.lit("")), F.coalesce(peers, F.lit("")))

    block = lambda head, keep: F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.filter("facts", keep), line), "\n"))
    rules = F.array_join(F.transform("triggered_rules", lambda r: F.concat(r["rule_id"], F.lit(" "), r["name"])), ", ")
    is_evidence = lambda f: F.size(f["triggering_rule_ids"]) > 0
    text = F.concat_ws("\n", F.concat(F.lit("User: "), F.col("user")), F.concat(F.lit("Period: "), F.col("period")), F.concat(F.lit("Rules: "), rules), block("Evidence:", is_evidence), block("Context:", lambda f: ~is_evidence(f)))
    return signals.select("signal_id", text.alias("context"))


def run_summary(labelled: DataFrame, alarm_rate: float = 0.05) -> DataFrame:
    """labelled: is_flagged, is_malicious per (user, period). Counts, rates, recall, and whether too much is flagged."""
    n, flagged = F.count("*"), F.count_if("is_flagged")
    bad, hit = F.count_if("is_malicious"), F.count_if(F.col("is_malicious") & F.col("is_flagged"))
    rate = F.try_divide(flagged, n)
    return labelled.agg(n.alias("periods"), flagged.alias("flagged"), rate.alias("flag_rate"), bad.alias("malicious"), hit.alias("malicious_flagged"), F.try_divide(hit, bad).alias("recall"), (rate > alarm_rate).alias("alarm"))
