"""Queries of signal records: facts, context texts, claims scored against facts, wordings, requests. Days of users stand in for
weeks; the SQL continues that of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import evaluation, grounding, identity, judgements, pooling, runs, signals
from plumbline.plans import standins as T
from plumbline.plans.queries import _DAY_LONG, _FIRED, _LABELLED, _SPLIT, GATES, _certified, _far, _six, _snapshots, _windows, query, r6, signal_records
from plumbline.sources.durable import durable

_rule_fields = {r.rule_id: r.fields for r in signals.RULES}
_evidence = [
    ("R1", "after_hours_logons", "true"), ("R2", "removable_media_copies", "true"), ("R3", "attachment_bytes", "true"), ("R3", "external_recipients", "true"), ("R4", "leak_site_visits", "leak_site_visits_v > 0"),
    ("R4", "job_search_visits", f"job_search_visits_v >= 5 AND {_far('job_search_visits')}"), *[("R5", f, _far(f)) for f in signals.VOLUMES],
]
_pair = lambda r, f: f"{{'r': '{r}', 'f': '{f}'}}"
_pairs = ", ".join(f"CASE WHEN list_contains(t, '{r}') AND ({c}) THEN {_pair(r, f)} END" for r, f, c in _evidence)
_context = ", ".join([f"CASE WHEN list_contains(t, '{r}') THEN '{f}' END" for r, fields in _rule_fields.items() for f in fields] + [f"'{f}'" for f in signals.ALWAYS])
_names = " ".join(f"WHEN '{r.rule_id}' THEN '{r.rule_id} {r.name}'" for r in signals.RULES)
_phrase = lambda z, capped: f"CASE WHEN {capped} THEN 'far outside' WHEN {z} >= 10 THEN 'far above' WHEN {z} >= 3 THEN 'clearly above' WHEN {z} <= -3 THEN 'clearly below' ELSE 'within' END"

#: facts: a row per fact of each signal, in order; sig: a row per signal.
_FACTS = f"""{_DAY_LONG}, {_FIRED},
sig AS (SELECT "user", period, t, substr(sha1("user" || '|' || period), 1, 12) AS signal_id, list_filter([{_pairs}], lambda x: x IS NOT NULL) AS ev, list_filter([{_context}], lambda x: x IS NOT NULL) AS ctx FROM fired JOIN w USING ("user", period) WHERE len(t) > 0),
wanted AS (SELECT signal_id, "user", period, ev, unnest(list_concat(list_transform(ev, lambda x: x.f), ctx)) AS field, unnest(range(1, len(ev) + len(ctx) + 1)) AS pos FROM sig),
firsts AS (SELECT signal_id, "user", period, field, any_value(ev) AS ev, min(pos) AS pos FROM wanted GROUP BY signal_id, "user", period, field),
known AS (SELECT f.*, b.* EXCLUDE ("user", period, feature, role), row_number() OVER (PARTITION BY signal_id ORDER BY pos) AS n FROM firsts f JOIN base b ON f."user" = b."user" AND f.period = b.period AND f.field = b.feature),
facts AS (SELECT signal_id, 'F' || lpad(n::VARCHAR, 3, '0') AS fact_id, field, value,
  CASE WHEN field = 'attachment_bytes' THEN CASE WHEN value >= 1e6 THEN printf('%.2f MB', value / 1e6) ELSE value::BIGINT || ' bytes' END WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE printf('%.2f', value) END AS display,
  replace(field, '_', ' ') AS gloss, array_to_string(list_transform(list_filter(ev, lambda x: x.f = field), lambda x: x.r), ',') AS triggering_rule_ids,
  CASE WHEN self_z IS NOT NULL THEN round(self_center, 3) END AS self_center, round(self_z, 2) AS self_z, abs(self_z) >= 50 AS self_z_capped, CASE WHEN self_z IS NOT NULL THEN self_hist_max END AS self_recent_max,
  CASE WHEN self_z IS NOT NULL THEN self_first END AS never_before, CASE WHEN peer_z IS NOT NULL THEN round(peer_center, 3) END AS peer_center, round(peer_z, 2) AS peer_z, abs(peer_z) >= 50 AS peer_z_capped,
  CASE WHEN peer_z IS NOT NULL THEN peer_n END::INT AS peer_group_size FROM known WHERE n <= 40)"""
_CONTEXT = f"""lines_ AS (SELECT signal_id, fact_id, triggering_rule_ids <> '' AS is_evidence, '- ' || fact_id || ' ' || gloss || ': ' || display
  || coalesce(CASE WHEN never_before THEN '; never before for this user' WHEN self_center IS NOT NULL THEN '; own typical ' || printf('%.2f', self_center) || ', ' || {_phrase("self_z", "self_z_capped")} END, '')
  || coalesce(CASE WHEN peer_center IS NOT NULL THEN '; peer typical ' || printf('%.2f', peer_center) || ' among ' || peer_group_size || ', ' || {_phrase("peer_z", "peer_z_capped")} END, '') AS line FROM facts),
joined AS (SELECT signal_id, coalesce(string_agg(line, chr(10) ORDER BY fact_id) FILTER (is_evidence), '') AS e, coalesce(string_agg(line, chr(10) ORDER BY fact_id) FILTER (NOT is_evidence), '') AS c, coalesce(string_agg(fact_id, ',' ORDER BY fact_id) FILTER (is_evidence), '') AS evidence_ids, count(*)::INT AS n_facts FROM lines_ GROUP BY signal_id),
contexts AS (SELECT signal_id, "user", period, evidence_ids, n_facts, array_to_string(list_transform(t, lambda r: CASE r {_names} END), ', ') AS rules,
  'User: ' || "user" || chr(10) || 'Period: ' || period || chr(10) || 'Rules: ' || array_to_string(list_transform(t, lambda r: CASE r {_names} END), ', ') || chr(10) || 'Evidence:' || chr(10) || e || chr(10) || 'Context:' || chr(10) || c AS context FROM sig JOIN joined USING (signal_id))"""


@query("g1_facts", f"WITH {_FACTS} SELECT * FROM facts")
def g1_facts(spark, sf_dir):
    """Facts of all signals, one row each."""
    # outer, as the optimizer else checks first whether there are facts, and works all of them out twice
    f = signal_records(spark, sf_dir).select("signal_id", F.explode_outer("facts").alias("f")).filter("f IS NOT NULL").select("signal_id", "f.*")
    return f.withColumn("triggering_rule_ids", F.array_join("triggering_rule_ids", ","))


@query("g3_signals", f"""WITH {_FACTS}, {_CONTEXT} SELECT signal_id, "user", period, 'day' AS period_type, rules, n_facts, evidence_ids, false AS is_malicious, context FROM contexts""")
def g3_signals(spark, sf_dir):
    """Signal records, their evidence ids and context text."""
    r = durable(signal_records(spark, sf_dir))
    rules = F.array_join(F.transform("triggered_rules", lambda x: F.concat_ws(" ", x["rule_id"], x["name"])), ", ")
    return signals.context_text(r).join(r.select("signal_id", "user", "period", "period_type", rules.alias("rules"), F.size("facts").alias("n_facts"), F.array_join(signals.evidence_ids(F.col("facts")), ",").alias("evidence_ids"), "label.is_malicious"), "signal_id")


_WINDOWS = _LABELLED.removeprefix(T.RAW_FEATURES + ", ")


@query(
    "g6_signal_run",
    f"""WITH {_FACTS}, {_WINDOWS} SELECT signal_id, "user", period, 'old G' || substr("user", 2)::BIGINT % 3 AS role, n_facts, is_malicious, scenario
FROM sig JOIN lab USING ("user", period) JOIN (SELECT signal_id, count(*)::INT AS n_facts FROM facts GROUP BY signal_id) USING (signal_id)""",
)
def g6_signal_run(spark, sf_dir):
    """From five logs, snapshots and answers to labelled records in one call; roles of the last snapshot make peers, records show those of their month."""
    users = T.events(spark, sf_dir).select("user").distinct()
    group = F.concat(F.lit("G"), F.substring("user", 2, 20).cast("long") % 3)
    others = [F.lit(c).alias(c) for c in identity.IDENTITY if c != "role"]
    months = users.select("user", F.explode(F.array(F.struct(F.lit("2000-01").alias("m"), F.concat(F.lit("old "), group).alias("role")), F.struct(F.lit("2999-01").alias("m"), group.alias("role")))).alias("x"))
    snapshots = months.select("user", F.col("x.m").alias("snapshot_month"), "x.role", *others)
    run = runs.signals_from_logs(T.logs(spark, sf_dir), snapshots, _windows(spark, sf_dir), GATES, grain="day")
    return run.signals.select("signal_id", "user", "period", "identity.role", F.size("facts").alias("n_facts"), "label.is_malicious", "label.scenario")


# ---------------------------------------------------------------- claims against facts

_CLAIM = """CASE n % 3 WHEN 0 THEN 'The reason is that ' || gloss || ' reached ' || display WHEN 1 THEN 'While activity (a, b) was normal, the user had ' || display || ' ' || gloss ELSE 'John Smith made 7777777 ' || gloss END"""
_CLAIMS = f"""fclaims AS (SELECT signal_id, 's' || lpad(n::VARCHAR, 3, '0') AS sentence_id, n, {_CLAIM} AS text FROM (SELECT *, substr(fact_id, 2)::INT AS n FROM facts)),
ftok AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS tok FROM fclaims),
fpairs AS (SELECT c.signal_id, c.sentence_id, s.n % 4 AS draft, len(c.tok) > 0 AND len(list_intersect(c.tok, s.tok)) / len(c.tok) >= 0.6 AS hit FROM ftok c JOIN ftok s ON c.signal_id = s.signal_id AND c.n % 4 <> s.n % 4),
fcons AS (SELECT signal_id, sentence_id, avg(hit::INT) AS self_consistency FROM (SELECT signal_id, sentence_id, draft, bool_or(hit) AS hit FROM fpairs GROUP BY ALL) GROUP BY ALL)"""
#: Scores of the claims; stored: numbers that a judge found in every fifth claim of a signal.
_close = lambda a, b, t: f"CASE WHEN {b} = 0 THEN abs({a}) < 1e-9 ELSE abs({a} - {b}) <= {t} * abs({b}) END"
_ROLES = """snaps AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS m, min(o_orderpriority) AS role FROM orders GROUP BY 1, 2),
as_of AS (SELECT o_custkey, role FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY m > '1997-01', abs(date_diff('month', (m || '-01')::DATE, DATE '1997-01-01'))) AS r FROM snaps) WHERE r = 1)"""


def _scored(stored: str) -> str:
    return f"""{_CLAIMS}, {_ROLES},
nums AS (SELECT signal_id, fact_id, unnest(list_filter([nullif(regexp_extract(replace(display, ',', ''), '^\\s*(-?\\d+(?:\\.\\d+)?)', 1), '')::DOUBLE, CASE WHEN NOT coalesce(never_before, false) THEN self_center END, peer_center, peer_group_size::DOUBLE], lambda x: x IS NOT NULL)) AS x FROM facts),
said AS (SELECT signal_id, sentence_id, {stored} AS numbers FROM fclaims),
each_ AS (SELECT signal_id, sentence_id, unnest(numbers) AS v, unnest(range(len(numbers))) AS i FROM said),
dn AS (SELECT DISTINCT signal_id, fact_id, x FROM nums), dpair AS (SELECT a.signal_id, a.x AS a, b.x AS b FROM dn a JOIN dn b ON a.signal_id = b.signal_id AND a.fact_id = b.fact_id AND a.x <> b.x WHERE b.x <> 0),
unit AS (SELECT signal_id, unnest([x * 1e3, x / 1e3, x * 1e6, x / 1e6, x * 1e9, x / 1e9]) AS y FROM dn),
good AS (SELECT DISTINCT e.signal_id, sentence_id, i FROM each_ e JOIN dn USING (signal_id) WHERE {_close("v", "x", 0.01)} UNION SELECT DISTINCT e.signal_id, sentence_id, i FROM each_ e JOIN unit USING (signal_id) WHERE {_close("v", "y", 0.01)}
  UNION SELECT DISTINCT e.signal_id, sentence_id, i FROM each_ e JOIN dpair USING (signal_id) WHERE {_close("v", "(a / b)", 0.05)} OR {_close("v", "(100 * (a / b))", 0.05)} OR {_close("v", "abs(100 * ((a - b) / b))", 0.05)}),
ngood AS (SELECT signal_id, sentence_id, count(*) AS g FROM good GROUP BY ALL),
who AS (SELECT signal_id, list_filter([lower(CASE WHEN substr("user", 2)::BIGINT % 2 = 0 THEN 'John Smith' ELSE 'Ann Lee' END), CASE WHEN substr("user", 2)::BIGINT % 2 = 0 THEN 'john' ELSE 'ann' END, CASE WHEN substr("user", 2)::BIGINT % 2 = 0 THEN 'smith' ELSE 'lee' END, lower(coalesce(role, '')), lower("user"), '1 - sales', 'sales'], lambda x: x <> '') AS k FROM sig LEFT JOIN as_of ON substr("user", 2)::BIGINT = o_custkey),
gl AS (SELECT signal_id, list(gloss) AS g FROM facts GROUP BY signal_id),
ents AS (SELECT c.signal_id, sentence_id, len(e) AS n_e, len(list_filter(e, lambda x: len(list_filter(list_concat(k, g), lambda y: contains(y, lower(x)) OR contains(lower(x), y))) > 0)) AS g_e
  FROM (SELECT *, regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b|\\b[A-Z]{{2,}}\\d{{2,}}\\b') AS e FROM fclaims) c JOIN who USING (signal_id) JOIN gl USING (signal_id)),
clause AS (SELECT signal_id, sentence_id, lower(CASE WHEN n % 3 = 1 THEN regexp_replace(text, '^While activity \\(a, b\\) was normal, ', '') ELSE text END) AS c FROM fclaims),
named AS (SELECT c.signal_id, sentence_id, bool_or(triggering_rule_ids <> '') AS ev, min(fact_id) FILTER (triggering_rule_ids = '') AS ctx FROM clause c JOIN facts f ON c.signal_id = f.signal_id AND len(list_filter(string_split(gloss, ' '), lambda x: length(x) >= 5 AND contains(c, x))) > 0 GROUP BY ALL),
mis AS (SELECT c.signal_id, c.sentence_id, CASE WHEN regexp_matches(c, '{"|".join(S.CAUSAL_PHRASES)}') AND NOT coalesce(ev, false) THEN ctx END AS misweighted_fact FROM clause c LEFT JOIN named USING (signal_id, sentence_id)),
score AS (SELECT signal_id || '_' || sentence_id AS cluster_id, signal_id, sentence_id, self_consistency, coalesce(g, 0) / nullif(len(numbers), 0) AS fact_match_score, (coalesce(g, 0) + g_e) / nullif(len(numbers) + n_e, 0) AS combined_score, misweighted_fact, len(numbers)::INT AS n_numbers, n_e::INT AS n_entities
  FROM said LEFT JOIN ngood USING (signal_id, sentence_id) JOIN ents USING (signal_id, sentence_id) JOIN mis USING (signal_id, sentence_id) LEFT JOIN fcons USING (signal_id, sentence_id))
SELECT cluster_id, signal_id, sentence_id, round(CASE WHEN misweighted_fact IS NOT NULL THEN 0 ELSE coalesce(fact_match_score, self_consistency) END, 6) AS rho, round(self_consistency, 6) AS self_consistency, round(fact_match_score, 6) AS fact_match_score,
  round(combined_score, 6) AS combined_score, misweighted_fact IS NOT NULL AS misweighted, misweighted_fact, n_numbers, n_entities FROM score"""


_own_numbers = "regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b')::DOUBLE[]"


def _fact_claims(records):
    """Claims from templates over each fact of each signal: its value, a value after a concession, or a number from nowhere."""
    f = records.select("signal_id", F.explode("facts").alias("f"))
    place = F.substring("f.fact_id", 2, 3).cast("int")
    text = (
        F.when(place % 3 == 0, F.concat(F.lit("The reason is that "), F.col("f.gloss"), F.lit(" reached "), F.col("f.display")))
        .when(place % 3 == 1, F.concat(F.lit("While activity (a, b) was normal, the user had "), F.col("f.display"), F.lit(" "), F.col("f.gloss")))
        .otherwise(F.concat(F.lit("John Smith made 7777777 "), F.col("f.gloss")))
    )
    return f.select("signal_id", F.concat(F.lit("s"), F.substring("f.fact_id", 2, 3)).alias("sentence_id"), text.alias("text"), (place % 4).alias("sample_index"))


def _score_rows(spark, sf_dir, stored=None):
    """Claims of four drafts, scored: agreement with other drafts (J1), the identity as of a month (D4), numbers and names against facts.
    stored: from claims to rows (signal_id, sentence_id, extra) of numbers that a judge found."""
    records = durable(signal_records(spark, sf_dir))
    claims = durable(_fact_claims(records))
    pairs = grounding.claim_pairs(claims.select("signal_id", "sentence_id", "text"), claims.select("signal_id", "sample_index", "text"), tokens=True)
    outside = pairs.filter(F.substring("sentence_id", 2, 3).cast("int") % 4 != F.col("sample_index"))
    consistency = grounding.self_consistency(grounding.judged(outside)).select("signal_id", "sentence_id", "self_consistency")
    users = records.select("user", F.substring("user", 2, 20).cast("long").alias("key")).distinct().select(F.col("key").alias("user"), F.lit("1997-01").alias("month"))
    roles = identity.identity_as_of(users, _snapshots(spark, sf_dir), ("role",)).select(F.concat(F.lit("U"), F.col("user")).alias("user"), "role")
    even = F.substring("user", 2, 20).cast("long") % 2 == 0
    person = F.struct(F.when(even, "John Smith").otherwise("Ann Lee").alias("employee_name"), "role", F.lit("1 - Sales").alias("functional_unit"), F.lit(None).cast("string").alias("team"))
    named = records.drop("identity").join(roles, "user", "left").withColumn("identity", person)
    if stored is None:
        scored = grounding.score_claims(claims, named, consistency)
    else:
        scored = grounding.score_claims(claims.join(stored(claims), ["signal_id", "sentence_id"], "left"), named, consistency, F.col("extra"))
    return scored.withColumns({c: r6(F.col(c)) for c in ("rho", "self_consistency", "fact_match_score", "combined_score")})


@query("j13_score_claims", f"WITH {_FACTS}, {_scored(_own_numbers)}")
def j13_score_claims(spark, sf_dir):
    """Whole score rows from a claim's numbers, names, weighting and agreement."""
    return _score_rows(spark, sf_dir)


@query("j15_given_numbers", f"WITH {_FACTS}, {_scored(f'CASE WHEN n % 5 = 0 THEN [7.0, n::DOUBLE] ELSE {_own_numbers} END')}")
def j15_given_numbers(spark, sf_dir):
    """The same where a judge's numbers replace those of every fifth claim."""
    place = F.substring("sentence_id", 2, 3).cast("int")
    return _score_rows(spark, sf_dir, lambda claims: claims.filter(place % 5 == 0).select("signal_id", "sentence_id", F.array(F.lit(7.0), place.cast("double")).alias("extra")))


# ---------------------------------------------------------------- wordings and requests

_PROFILE = """profile AS (SELECT signal_id, coalesce(string_agg(DISTINCT peer_group_size::VARCHAR, ','), '') AS sizes_, list_sort(list_distinct(list(peer_group_size) FILTER (peer_group_size IS NOT NULL))) AS sizes, coalesce(bool_or(value > self_recent_max AND NOT coalesce(never_before, false)), false) AS true_exceedance,
  list_sort(list_filter(list_distinct(coalesce(list(self_recent_max) FILTER (self_recent_max IS NOT NULL AND NOT coalesce(never_before, false)), [])), lambda m: NOT list_contains(list_concat(list(value), coalesce(list(self_center) FILTER (self_center IS NOT NULL), []), coalesce(list(peer_center) FILTER (peer_center IS NOT NULL), []), coalesce(list(peer_group_size::DOUBLE) FILTER (peer_group_size IS NOT NULL), []), [9.0]), m))) AS maxima FROM facts GROUP BY signal_id)"""


def _profiles(records):
    """Profiles of signals whose identity shows a number, that of a team."""
    return evaluation.signal_profile(records.withColumn("identity", F.struct(F.lit("Clerk").alias("role"), F.lit("9 - Sales").alias("team"))))


@query("m8_signal_profile", f"WITH {_FACTS}, {_PROFILE} SELECT signal_id, coalesce(array_to_string(sizes, ','), '') AS peer_sizes, true_exceedance, array_to_string(list_transform(maxima, lambda x: x::BIGINT), ',') AS hidden_maxima FROM profile")
def m8_signal_profile(spark, sf_dir):
    """Peer sizes, true exceedance, and maxima that nothing shown equals (M8)."""
    p = _profiles(signal_records(spark, sf_dir))
    whole = F.array_join(F.transform("hidden_maxima", lambda x: x.cast("long").cast("string")), ",")
    return p.select("signal_id", F.array_join(F.transform("peer_sizes", lambda x: x.cast("string")), ",").alias("peer_sizes"), "true_exceedance", whole.alias("hidden_maxima"))


_OLD = "This exceeds the recent maximum of 5 sigma in the past 12 weeks. "
_EXCEEDS = evaluation.WORDINGS["exceeds_max"].replace("'", "''")
_SIGMA = evaluation.WORDINGS["sigma"].replace("'", "''")
_HITS = rf"""said AS (SELECT 'before' AS version, signal_id, '{_OLD}' || context AS text FROM contexts UNION ALL SELECT 'after', signal_id, context FROM contexts),
hits AS (SELECT version, true_exceedance, len(regexp_extract_all(text, '{_EXCEEDS}')) AS exceeds_max, len(regexp_extract_all(text, '{_SIGMA}')) AS sigma,
  CASE WHEN len(sizes) > 0 THEN len(regexp_extract_all(text, '\b(?:out of|of|among|amongst|across)\s+(?:the\s+)?(?:' || array_to_string(sizes, '|') || ')\b')) - len(regexp_extract_all(text, '\b(?:out of|of|among|amongst|across)\s+(?:the\s+)?(?:' || array_to_string(sizes, '|') || ')\b\s+(?:peers|same-role|colleagues|others)')) ELSE 0 END AS peer_denominator,
  len(list_filter(regexp_extract_all(regexp_replace(text, '(?i)\[?\bR\d+\]?|\b\d{{4}}-W\d{{1,2}}\b|\b\d+[- ]?weeks?\b', ' ', 'g'), '[0-9.]+'), lambda x: list_contains(list_transform(maxima, lambda m: m::BIGINT::VARCHAR), x))) AS max_figure FROM said JOIN profile USING (signal_id)),
long_ AS (SELECT version, true_exceedance, unnest(['exceeds_max', 'sigma', 'peer_denominator', 'max_figure']) AS wording, unnest([exceeds_max, sigma, peer_denominator, max_figure]) AS n FROM hits)
SELECT true_exceedance, wording, sum(n) FILTER (version = 'before')::BIGINT AS before_hits, count(*) FILTER (version = 'before' AND n > 0) AS before_drafts, sum(n) FILTER (version = 'after')::BIGINT AS after_hits, count(*) FILTER (version = 'after' AND n > 0) AS after_drafts FROM long_ GROUP BY ALL"""


@query("m10_wordings", f"WITH {_FACTS}, {_CONTEXT}, {_PROFILE}, {_HITS}")
def m10_wordings(spark, sf_dir):
    """Two wordings of drafts over the same signals, compared."""
    r = durable(signal_records(spark, sf_dir))
    profiles = _profiles(r)
    context = signals.context_text(r)
    old = context.select("signal_id", F.lit(0).alias("sample_index"), F.concat(F.lit(_OLD), F.col("context")).alias("text"))
    new = context.select("signal_id", F.lit(0).alias("sample_index"), F.col("context").alias("text"))
    return evaluation.wording_comparison(evaluation.wording_hits(old, profiles), evaluation.wording_hits(new, profiles))


@query(
    "n1_generation_requests",
    f"""WITH {_FACTS}, {_CONTEXT} SELECT json_object('request_id', signal_id, 'request', json_object('contents', [json_object('parts', [json_object('text', 'Describe the user''s period.' || chr(10) || chr(10) || context)])], 'generation_config', json_object('temperature', 0.7)))::VARCHAR AS value FROM contexts""",
)
def n1_generation_requests(spark, sf_dir):
    """Generation requests as JSON lines."""
    return judgements.generation_requests(signals.context_text(signal_records(spark, sf_dir)), "Describe the user's period.")


@query(
    "n2_grouping_requests",
    rf"""WITH {T.LINES}, k AS (SELECT *, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS key FROM lines),
p AS (SELECT signal_id, key, arg_min(text, (sample_index, pos)) AS text, min((sample_index, pos)) AS first FROM k GROUP BY signal_id, key), n AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY first) - 1 AS i FROM p)
SELECT signal_id, count(*)::INT AS n_keys, md5('Group what means the same.' || chr(10) || chr(10) || string_agg('[' || i || '] ' || text, chr(10) ORDER BY i)) AS prompt FROM n GROUP BY signal_id""",
)
def n2_grouping_requests(spark, sf_dir):
    """Grouping requests over a conversation's lines, with the prompt read back from the JSON line."""
    lines = T.turn_lines(spark, sf_dir)
    claims = pooling.pool_exact(lines.withColumn("key", S.identity_key(F.col("text"))))
    made = judgements.grouping_requests(claims, "Group what means the same.")
    prompt = F.get_json_object("value", "$.request.contents[0].parts[0].text")
    return made.select("signal_id", F.size("keys").alias("n_keys"), F.md5(prompt.cast("binary")).alias("prompt"))


_WRONG = "label IN ('hallucinated', 'misweighted', 'false precision')"


@query(
    "l7_calibration_run",
    f"""WITH {_SPLIT}, cal AS (SELECT * FROM split WHERE in_calibration), {_certified('cal', _six)},
far AS (SELECT "lambda", count(*) FILTER (score >= "lambda") AS other_selected, count(*) FILTER (score >= "lambda" AND {_WRONG}) AS other_wrong FROM grid, (SELECT * FROM split WHERE NOT in_calibration) GROUP BY "lambda")
SELECT alpha, lambda_hat, n_selected, n_wrong, status, other_selected, other_wrong FROM best LEFT JOIN far ON lambda_hat = "lambda" """,
)
def l7_calibration_run(spark, sf_dir):
    """From scored and judged claims to certified thresholds in one call, with the other side's figures at each."""
    rows = T.claims_by_label(spark, sf_dir)
    users = rows.select("user", "group").distinct()
    run = runs.thresholds_from_judgements(rows.select("cluster_id", F.col("score").alias("rho")), rows.select("cluster_id", "user", "label"), {"source": "documents"}, users, ("primary",))
    return run.thresholds.filter("method = 'learn then test'").select("alpha", "lambda_hat", "n_selected", "n_wrong", "status", "other_selected", "other_wrong")
