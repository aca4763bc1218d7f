"""Scores of claims: agreement among drafts, match of numbers and names with facts, weighting, and the combined score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S

#: What a number may stand for, and how close it must be.
TARGETS = {"value": 0.01, "ratio": 0.05, "percent": 0.05, "percent difference": 0.05, "unit": 0.01}
DETAILS = tuple(TARGETS)
UNITS = (1e3, 1e6, 1e9)
ENTAILED = 0.6


def claim_pairs(claims: DataFrame, sentences: DataFrame, keys: tuple[str, ...] = ("signal_id",), tokens: bool = False) -> DataFrame:
    """Every claim with every sentence of the same signal's drafts. claims: signal_id, sentence_id, text; sentences: signal_id,
    sample_index, text. A signal has k drafts, so pairs grow with signals. tokens: each text's tokens too, found once a text instead of once a pair.
    Both sides are dealt by signal, as a few texts make many pairs, and Spark would else size its tasks by the texts."""
    deal = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    more = lambda name: [S.tokens_of(F.col("text")).alias(f"{name}_tokens")] if tokens else []
    c = deal(claims).select(*keys, "sentence_id", F.col("text").alias("hypothesis"), *more("hypothesis"))
    return c.join(deal(sentences).select(*keys, "sample_index", F.col("text").alias("premise"), *more("premise")), list(keys))


def pair_key() -> Column:
    """16 bytes that stand for premise and hypothesis."""
    return F.unhex(F.md5(F.concat(F.md5(F.col("premise").cast("binary")), F.md5(F.col("hypothesis").cast("binary"))).cast("binary")))


def judged(pairs: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """Adds entailed: a stored judgement (premise, hypothesis, label; or pair_key, label) where there is one, else token overlap; without texts, pairs
    that have no null one. Pairs meet judgements by pair_key and leave their texts behind, so a shuffle of pairs holds none."""
    whole = pairs.filter(F.col("premise").isNotNull() & F.col("hypothesis").isNotNull())
    if {"hypothesis_tokens", "premise_tokens"} <= set(pairs.columns):
        overlap = S.share_of_tokens(F.col("hypothesis_tokens"), F.col("premise_tokens"))
    else:
        overlap = S.token_overlap(F.col("hypothesis"), F.col("premise"))
    others = [c for c in pairs.columns if c not in ("premise", "hypothesis", "premise_tokens", "hypothesis_tokens")]
    if judgements is None:
        return whole.select(*others, (overlap >= ENTAILED).alias("entailed"))
    known = judgements if "pair_key" in judgements.columns else judgements.select(pair_key().alias("pair_key"), "label")
    rows = whole.select(*others, pair_key().alias("pair_key"), (overlap >= ENTAILED).alias("_overlap"))
    return rows.join(known.select("pair_key", "label"), "pair_key", "left").select(*others, F.coalesce(F.col("label") == "entailment", "_overlap").alias("entailed"))


def self_consistency(judged_pairs: DataFrame, exclude: Column | None = None) -> DataFrame:
    """Share of the drafts with a sentence that entails the claim; the draft where `exclude` holds is left out. A claim with no
    draft to compare gets no row."""
    rows = judged_pairs if exclude is None else judged_pairs.filter(~exclude)
    by_draft = rows.groupBy("signal_id", "sentence_id", "sample_index").agg(F.bool_or("entailed").alias("hit"))
    return by_draft.groupBy("signal_id", "sentence_id").agg(F.avg(F.col("hit").cast("int")).alias("self_consistency"), F.count("*").alias("n_drafts"))


def leading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def rendered_numbers(fact: Column) -> Column:
    """What a reader of the fact saw: shown value, own centre unless it never happened before, peer centre, group size. Recent
    maxima and z values were not shown."""
    own = F.when(~F.coalesce(fact["never_before"], F.lit(False)), fact["self_center"])
    return F.array_compact(F.array(leading_number(fact["display"]), own, fact["peer_center"], fact["peer_group_size"].cast("double")))


def close(a: Column, b: Column, tolerance: Column | float) -> Column:
    """Within a share of b; of 0, within a billionth."""
    t = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    return F.when(b == 0, F.abs(a) < 1e-9).otherwise(F.abs(a - b) <= t * F.abs(b))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidates(facts: Column) -> Column:
    """Ordered targets of a signal's facts: rendered numbers of all facts, then for each fact ratios, percents and percent differences of two
    of its numbers and unit changes: struct(target, what, fact); what: place in TARGETS, fact: place among the facts."""

    def made(target: Column, detail: str, place: Column) -> Column:
        return F.struct(target.alias("target"), F.lit(DETAILS.index(detail)).alias("what"), place.alias("fact"))

    direct = lambda n, i: F.transform(n, lambda x: made(x, "value", i))

    def derived(n: Column, i: Column) -> Column:
        pairs = F.flatten(F.transform(n, lambda a: F.transform(F.filter(n, lambda b: b != a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        of = lambda p: F.array(made(F.try_divide(p["a"], p["b"]), "ratio", i), made(100 * F.try_divide(p["a"], p["b"]), "percent", i), made(F.abs(100 * F.try_divide(p["a"] - p["b"], p["b"])), "percent difference", i))
        units = F.flatten(F.transform(n, lambda a: F.array(*[made(x, "unit", i) for u in UNITS for x in (a * u, a / u)])))
        return F.concat(F.filter(F.flatten(F.transform(pairs, of)), lambda c: c["target"].isNotNull()), units)

    # numbers are read out of a fact once, not once for each of its pairs
    return let(F.transform(facts, rendered_numbers), lambda numbers: F.concat(F.flatten(F.transform(numbers, direct)), F.flatten(F.transform(numbers, derived))))


def number_index(facts: Column) -> Column:
    """Targets of a signal in the order of their values, each with its rank among the candidates: array of struct(target, rank, what, fact).
    Made once a signal, searched by every number of its claims."""
    ranked = F.transform(candidates(facts), lambda c, i: F.struct(c["target"].alias("target"), i.alias("rank"), c["what"].alias("what"), c["fact"].alias("fact")))
    return F.coalesce(F.sort_array(ranked), F.filter(F.array(F.struct(F.lit(0.0).alias("target"), F.lit(0).alias("rank"), F.lit(0).alias("what"), F.lit(0).alias("fact"))), lambda c: F.lit(False)))


def count_below(index: Column, steps: Column, least: Column) -> Column:
    """How many targets are below `least`, by binary search in steps of falling powers of two; past the end there is nothing to step on."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(index, at + step - 1)["target"] < least, at + step).otherwise(at))


def match_number(number: Column, index: Column, steps: Column, facts: Column) -> Column:
    """The close target of least rank: struct(number, kind, fact_id, detail); kind `unmatched` if none is close. A close target t of a number n
    lies between n / (1 + w) and n / (1 - w), w the widest tolerance; only those few are compared. An infinite target is close to nothing."""
    widest = max(TARGETS.values())
    ends, margin = (number / (1 + widest), number / (1 - widest)), F.abs(number) * 1e-9 + 1e-9
    tolerances = F.array(*[F.lit(t) for t in TARGETS.values()])

    def first(begin: Column) -> Column:
        near = F.slice(index, begin + 1, count_below(index, steps, F.greatest(*ends) + margin) - begin)
        hits = F.filter(near, lambda c: close(number, c["target"], F.get(tolerances, c["what"])))
        return F.array_min(F.transform(hits, lambda c: F.struct(c["rank"], c["what"].alias("what"), c["fact"].alias("fact"))))

    def named(hit: Column) -> Column:
        kind = F.when(hit.isNull(), "unmatched").when(hit["what"] == DETAILS.index("value"), "matched").otherwise("derived")
        return F.struct(number.alias("number"), kind.alias("kind"), F.get(facts, hit["fact"])["fact_id"].alias("fact_id"), F.get(F.array(*[F.lit(d) for d in DETAILS]), hit["what"]).alias("detail"))

    return let(let(count_below(index, steps, F.least(*ends) - margin), first), named)


def match_numbers(rows: DataFrame, numbers: Column | None = None, index: Column | None = None) -> DataFrame:
    """rows: text, facts. Adds numbers (those of the text, or the ones given where not null) and matches. index: the signal's number_index,
    where it is at hand; else it is made for each row. Null facts match nothing."""
    own = S.numbers_in(F.col("text"))
    rows = rows.withColumn("numbers", own if numbers is None else F.coalesce(numbers, own))
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])  # no array is longer
    every = lambda i: let(F.filter(powers, lambda p: p <= F.size(i)), lambda steps: F.transform(F.col("numbers"), lambda n: match_number(n, i, steps, F.col("facts"))))
    return rows.withColumn("matches", let(number_index(F.col("facts")) if index is None else index, every))


def share_grounded(matches: Column) -> Column:
    """Share of numbers that are matched or derived; null if there are none."""
    return F.try_divide(F.size(F.filter(matches, lambda m: m["kind"] != "unmatched")), F.nullif(F.size(matches), F.lit(0)))


def known_entities(user: Column, identity: Column, facts: Column) -> Column:
    """Lower-cased names that a claim may use: name and its parts, role, team, unit (also without `N - `), user id, glosses."""
    name, unit = S.clean_identity(identity["employee_name"]), S.clean_identity(identity["functional_unit"])
    one = F.array(name, S.clean_identity(identity["role"]), S.clean_identity(identity["team"]), unit, F.regexp_replace(unit, r"^\d+ - ", ""), F.coalesce(user, F.lit("")))
    every = F.concat(one, F.split(name, " "), F.transform(facts, lambda f: f["gloss"]))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def entity_matches(entities: Column, known: Column) -> Column:
    """For each entity, whether it holds or is held by a known one."""
    return F.transform(entities, lambda e: F.exists(known, lambda k: F.contains(k, F.lower(e)) | F.contains(F.lower(e), k)))


def combined_match(matches: Column, entity_hits: Column) -> Column:
    """Share of numbers and entities that match; null if there are none of either."""
    good = F.size(F.filter(matches, lambda m: m["kind"] != "unmatched")) + F.size(F.filter(entity_hits, lambda h: h))
    return F.try_divide(good, F.nullif(F.size(matches) + F.size(entity_hits), F.lit(0)))


def misweighted_fact(text: Column, facts: Column) -> Column:
    """Id of the first context fact that a causal main clause rests on while it names no evidence; null otherwise."""
    words = lambda f: F.filter(F.split(F.lower(f["gloss"]), r"\W+"), lambda w: F.length(w) >= 5)
    is_evidence = lambda f: F.size(f["triggering_rule_ids"]) > 0

    def found(clause: Column) -> Column:
        named = lambda f: F.exists(words(f), lambda w: F.contains(clause, w))
        evidence = F.exists(F.filter(facts, is_evidence), named)
        context = F.get(F.filter(facts, lambda f: ~is_evidence(f) & named(f)), F.lit(0))
        return F.when(S.has_causal_language(clause) & ~F.coalesce(evidence, F.lit(False)), context["fact_id"])

    return let(F.lower(S.main_clause(text)), found)  # cut out once a claim, not once a word


def rho(misweighted: Column, fact_match: Column, consistency: Column) -> Column:
    """0 if misweighted, else the fact match, else the agreement."""
    return F.when(misweighted, 0.0).otherwise(F.coalesce(fact_match, consistency))


def score_claims(claims: DataFrame, signals: DataFrame, consistency: DataFrame, extra_numbers: Column | None = None) -> DataFrame:
    """claims: signal_id, sentence_id, text; signals: signal_id, user, identity, facts; consistency: signal_id, sentence_id,
    self_consistency. The whole score row of each claim. Targets are made and sorted once a signal, before its claims meet it."""
    known = signals.select("signal_id", "user", "identity", "facts", number_index(F.col("facts")).alias("_index"))
    rows = claims.join(consistency, ["signal_id", "sentence_id"], "left").join(known, "signal_id")
    rows = match_numbers(rows, extra_numbers, F.col("_index")).withColumn("entities", S.entities_in(F.col("text")))
    rows = rows.withColumn("hits", entity_matches(F.col("entities"), known_entities(F.col("user"), F.col("identity"), F.col("facts"))))
    rows = rows.withColumn("misweighted_fact", misweighted_fact(F.col("text"), F.col("facts"))).withColumn("misweighted", F.col("misweighted_fact").isNotNull())
    rows = rows.withColumn("fact_match_score", share_grounded(F.col("matches"))).withColumn("combined_score", combined_match(F.col("matches"), F.col("hits")))
    return rows.select(
        S.cluster_id(F.col("signal_id"), F.col("sentence_id")).alias("cluster_id"), "signal_id", "sentence_id", rho(F.col("misweighted"), F.col("fact_match_score"), F.col("self_consistency")).alias("rho"),
        "self_consistency", "fact_match_score", "combined_score", "misweighted", "misweighted_fact", F.size("numbers").alias("n_numbers"), F.size("entities").alias("n_entities"),
    )


def best_siblings(pairs: DataFrame, overlap: Callable[[Column, Column], Column] = S.content_overlap, least: float = 0.30, top: int = 3) -> DataFrame:
    """pairs: signal_id, sentence_id, hypothesis, sample_index, premise. Each claim's best sentence in each draft, ranked; the
    `top` of at least `least`."""
    scored = pairs.withColumn("overlap", overlap(F.col("hypothesis"), F.col("premise"))).filter(F.col("overlap") >= least)
    best = scored.groupBy("signal_id", "sentence_id", "sample_index").agg(F.max(F.struct("overlap", "premise")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("signal_id", "sentence_id").orderBy(F.desc("b.overlap"), "sample_index"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("signal_id", "sentence_id", "sample_index", "rank", F.col("b.premise").alias("premise"), F.col("b.overlap").alias("overlap"))
