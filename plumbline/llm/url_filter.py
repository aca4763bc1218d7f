"""URL filter: allow and block rules, and gradient-boosted trees for what no rule decides (operator 3).

Rules are written `host/path`; one fits its host and all subdomains when the url's path starts with the rule's path, and
the longest fitting rule wins. The urls that rules decide are the labelled ones: trees are trained on their lexical
features (lengths, depths, digit share, entropy, parameter counts, statistics of the host's suffixes and the path's first part) and judge all others. Training uses
at most TRAINING_ROWS labelled urls, chosen by a hash of the url; suffix statistics count all urls. The share of allowed urls
that a labelled one gets as a feature is that of the other FOLDS (by a hash of the url), so no url's label is in its own features.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the trees like
any other; repeated rows are judged each; if rules decide no url, or all alike, the others get that one verdict (allow
where there is none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, lower_ascii, table

ALLOW, BLOCK = "allow", "block"
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))
TRAINING_ROWS = 100_000
TREES, DEPTH, SEED = 15, 4, 7
FOLDS = 5
BROADCAST_ROWS = 100_000
#: Values with at least 1 / FREQUENT of all urls are joined by broadcast where the whole table is too long for it.
FREQUENT = 10_000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, slash, start = rule.partition("/")
        out = F.when(((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + start)), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for text, verdict in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_share", "entropy", "n_parameters", "query_length", "n_hyphens", "upper_share", "suffix_share", "suffix_allowed", "site_share", "site_allowed", "section_share", "section_allowed")


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url parts, rule and label (1: allow, 0: block, null: undecided), and features without the suffix statistics."""
    df = pages.select("page_id", F.coalesce("url", F.lit("")).alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    query, n = F.regexp_extract("u", r"\?([^#]*)", 1), F.greatest(F.length("u"), F.lit(1))
    return df.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(verdict_of(F.col("rule"), rules) == ALLOW, 1.0).when(F.col("rule").isNotNull(), 0.0).alias("label"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("site"),
        F.get(F.split("path", "/", 3), F.lit(1)).alias("section"),
        F.xxhash64("u").alias("hash"),
        F.length("u").cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        _count(F.col("host"), ".").alias("host_depth"),
        _count(F.col("path"), "/").alias("path_depth"),
        (_count(F.col("u"), "0123456789") / n).alias("digit_share"),
        entropy(F.col("u")).alias("entropy"),
        (_count(query, "&") + F.when(query != "", 1.0).otherwise(0.0)).alias("n_parameters"),
        F.length(query).cast("double").alias("query_length"),
        _count(F.col("u"), "-_").alias("n_hyphens"),
        (_count(F.col("u"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n).alias("upper_share"),
    )


def with_statistics(df: DataFrame, key: str) -> DataFrame:
    """Adds the share of all urls with the same value of `key`, and the smoothed share of allowed ones among its labelled urls (of other
    folds, for a labelled url)."""
    fold = F.pmod("hash", F.lit(FOLDS))
    folds = [x.alias(f"_{name}{f}") for f in range(FOLDS) for name, x in (("labelled", F.count(F.when(fold == f, F.col("label")))), ("allowed", F.sum(F.when(fold == f, F.coalesce("label", F.lit(0.0))).otherwise(0.0))))]
    stats = durable(df.groupBy(key).agg(F.count("*").alias("_n"), *folds))
    total = stats.agg(F.sum("_n")).first()[0] or 1

    def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, rows[key].eqNullSafe(found[key])).drop(found[key])

    if stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = joined(df, F.broadcast(stats))
    else:
        often = F.col("_n") * FREQUENT >= total
        frequent = F.broadcast(stats.filter(often))
        rare = df.join(frequent, df[key].eqNullSafe(frequent[key]), "left_anti")
        out = joined(df, frequent).unionByName(joined(rare, stats.filter(~often)))
    known = F.col("label").isNotNull()
    others = lambda name: sum((F.when(known & (fold == f), F.lit(0)).otherwise(F.col(f"_{name}{f}")) for f in range(FOLDS)), F.lit(0))
    out = out.withColumn(f"{key}_share", F.col("_n") / F.lit(total)).withColumn(f"{key}_allowed", (others("allowed") + 1) / (others("labelled") + 2))
    return out.drop("_n", *[f"_{name}{f}" for f in range(FOLDS) for name in ("labelled", "allowed")])


def with_suffix_statistics(df: DataFrame) -> DataFrame:
    """Statistics of the host's last label, of its last two, and of the path's first part."""
    for key in ("suffix", "site", "section"):
        df = with_statistics(df, key)
    return df


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """A row per page: page_id, host, path, rule, allowed (probability, null where a rule decides) and verdict."""
    df = with_suffix_statistics(durable(lexical(pages, rules))).withColumn("features", array_to_vector(F.array(*FEATURES)))
    labelled = df.filter(F.col("label").isNotNull())
    n, low, high = labelled.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if n and low != high:
        training = labelled
        if n > TRAINING_ROWS:
            training = labelled.filter(F.pmod("hash", F.lit(1_000_000)) < int(1_000_000 * TRAINING_ROWS / n))
        training = durable(training.select("features", "label").orderBy("hash").coalesce(8))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(training)
        judged = model.transform(df).withColumn("allowed", vector_to_array("probability")[1])
    else:
        judged = df.withColumn("allowed", F.lit(1.0 if low is None else low))
    by_rule = verdict_of(F.col("rule"), rules)
    return judged.select(
        "page_id", "host", "path", "rule", F.when(by_rule.isNull(), F.col("allowed")).alias("allowed"), F.coalesce(by_rule, F.when(F.col("allowed") >= 0.5, ALLOW).otherwise(BLOCK)).alias("verdict")
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("allowed")
