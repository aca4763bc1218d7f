"""Quality rules whose cut-offs adapt to each language and source (operator 7, built-in functions only).

Every document gets integer measures. Each measure is counted on a fixed grid per (lang, source): a quantile sketch
that merges by adding counts, with an error of one grid step at most and a size that does not depend on the rows.
Quantiles of a group are drawn towards those of its language's merged sketch, and these towards those of everything, as if WIDER more
documents of the wider sketch were in the group: the fewer documents, the more. Cut-offs are the median plus or minus a multiple of the half spread on the clean side, and are joined back to the measures.

Defined results: null or empty text has 0 words and fails; null lang or source is a group of its own; repeated rows are
judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SEPARATOR_CHARS, UPPER, durable, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents that the next wider sketch counts for.
WIDER = 200
#: measure: (side, multiple of the half spread, least half spread, grid cells). Shares are in thousandths, word length in hundredths.
MEASURES = {
    "symbol_share": ("high", 6, 10, 1000),
    "upper_share": ("high", 6, 40, 1000),
    "mark_share": ("high", 6, 10, 1000),
    "dup_line_share": ("high", 6, 80, 1000),
    "word_length": ("both", 8, 60, 6400),
}
#: Above this many threshold rows the join is left to Spark's shuffle.
BROADCAST_ROWS = 100_000
POSITION_BITS = 24


def _n_chars_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _div(a: Column, b: Column) -> Column:
    return F.expr("0").cast("long") if a is None else F.when(b > 0, F.floor(a / b)).otherwise(F.lit(0)).cast("long")


def repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words covered by 3-word windows that occur twice or more in the array `words`.

    Windows are compared by 64-bit hashes inside one text. Packed (hash, place) numbers are sorted to find neighbours
    with equal hashes; only those few are sorted again by whole hashes."""
    low = (1 << POSITION_BITS) - 1
    df = df.withColumn("_n3", F.greatest(F.size(words) - 2, F.lit(0)))
    df = df.withColumn("_h", F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2))), 1, F.col("_n3")))
    df = df.withColumn("_p", F.when(F.col("_n3") <= low, F.sort_array(F.transform("_h", lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long"))))))
    near = lambda i, by: F.shiftrightunsigned(F.get(F.col("_p"), i + by), POSITION_BITS)
    df = df.withColumn(
        "_c",
        F.when(F.col("_p").isNull(), F.sequence(F.lit(0), F.col("_n3") - 1).cast("array<bigint>")).otherwise(
            F.transform(
                F.filter("_p", lambda p, i: (F.shiftrightunsigned(p, POSITION_BITS) == near(i, -1)) | (F.shiftrightunsigned(p, POSITION_BITS) == near(i, 1))),
                lambda p: p.bitwiseAND(F.lit(low).cast("long")),
            )
        ),
    )
    df = df.withColumn("_s", F.sort_array(F.transform("_c", lambda c: F.struct(F.get(F.col("_h"), c.cast("int")).alias("h"), c.alias("at")))))
    same = lambda x, i, by: x["h"] == F.get(F.col("_s"), i + by)["h"]
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["at"])))
    df = df.withColumn(out, F.aggregate(F.transform("_at", lambda a, i: F.coalesce(F.least(F.lit(3), F.get(F.col("_at"), i + 1) - a), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))
    return df.drop("_n3", "_h", "_p", "_c", "_s", "_at")


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_key (xxhash64 of the text), the counts of the contract, base_failed and the grid cells of MEASURES."""
    df = documents.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_t"), F.xxhash64("text").alias("text_key"))
    df = df.withColumn("_w", words_of(F.col("_t")))
    df = repeat_words(df, "_w", "n_repeat_words")
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SEPARATOR_CHARS, "")).cast("long").alias("word_chars"),
        _n_chars_in(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_l").cast("long").alias("_lines"),
        _n_chars_in(F.col("_t"), UPPER).cast("long").alias("_upper"),
        _n_chars_in(F.col("_t"), "!?").cast("long").alias("_marks"),
    )
    return df.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        _div(1000 * F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        _div(1000 * F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        _div(1000 * F.col("_marks"), F.col("word_chars")).alias("mark_share"),
        _div(1000 * F.col("n_dup_lines"), F.col("_lines")).alias("dup_line_share"),
        F.least(_div(100 * F.col("word_chars"), F.col("n_words")), F.lit(6400)).alias("word_length"),
    ).drop("_lines", "_upper", "_marks")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by (lang, source, measure, cell): the mergeable sketches."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("cell")) for m in MEASURES])
    return measured.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.measure", "x.cell").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Count, tenth, median and ninetieth percentile of each merged sketch (keys + measure)."""
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("_up", F.sum("n").over(by.orderBy("cell"))).withColumn("_all", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("_up") * 100 >= F.col("_all") * q, F.col("cell")))
    return run.groupBy(*keys, "measure").agg(*[x.alias(f"{name}{suffix}") for x, name in ((F.max("_all"), "n"), (at(10), "q10_"), (at(50), "q50_"), (at(90), "q90_"))])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with low_<measure> and high_<measure>; grids bound the rows that windows hold."""
    own = _quantiles(sketch, ["lang", "source"], "0")
    lang = _quantiles(sketch, ["lang"], "1").withColumnRenamed("lang", "_lang").withColumnRenamed("measure", "_m1")
    whole = _quantiles(sketch, [], "2").withColumnRenamed("measure", "_m2")
    x = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_m1"))).join(whole, F.col("measure") == F.col("_m2"))
    drawn = lambda n, own, wider: (F.col(n) * F.col(own) + WIDER * wider) / (F.col(n) + WIDER)
    pick = lambda q: drawn("n0", f"{q}0", drawn("n1", f"{q}1", F.col(f"{q}2")))
    x = x.select("lang", "source", "measure", pick("q10_").alias("q10"), pick("q50_").alias("q50"), pick("q90_").alias("q90"))
    limits = []
    for m, (side, k, least, _) in MEASURES.items():
        here = F.col("measure") == m
        limits.append(F.max(F.when(here, F.col("q50") + k * F.greatest(F.col("q50") - F.col("q10"), F.lit(least)))).alias(f"high_{m}"))
        if side == "both":
            limits.append(F.max(F.when(here, F.col("q50") - k * F.greatest(F.col("q90") - F.col("q50"), F.lit(least)))).alias(f"low_{m}"))
    return x.groupBy("lang", "source").agg(*limits)


def apply_rules(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, lang, source, text_key, counts, base_failed and kept."""
    measured = durable(measures(documents))
    limits = durable(thresholds(sketches(measured))).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    good = ~F.col("base_failed")
    for m, (side, *_rest) in MEASURES.items():
        good &= F.col(m) <= F.col(f"high_{m}")
        if side == "both":
            good &= F.col(m) >= F.col(f"low_{m}")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", "lang", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(good, F.lit(False)).alias("kept"))


def op7(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return apply_rules(table(spark, sf_dir, "documents")).drop("lang", "source", "text_key")


def _oracle() -> str:
    cells = ", ".join(f"('{m}', {m})" for m in MEASURES)
    unions = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS cell FROM cells" for m in MEASURES)
    del cells

    def quant(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}measure"
        return f"""{name}_c AS (SELECT {keys}measure, cell, count(*) AS n FROM long GROUP BY {keys}measure, cell),
{name}_r AS (SELECT *, sum(n) OVER ({part} ORDER BY cell) AS up, sum(n) OVER ({part}) AS total FROM {name}_c),
{name} AS (SELECT {keys}measure, max(total) AS n, min(cell) FILTER (up * 100 >= total * 10) AS q10, min(cell) FILTER (up * 100 >= total * 50) AS q50,
  min(cell) FILTER (up * 100 >= total * 90) AS q90 FROM {name}_r GROUP BY {keys}measure)"""

    drawn = lambda side, q, wider: f"(({side}.n * {side}.{q})::DOUBLE + {WIDER} * ({wider})::DOUBLE) / ({side}.n + {WIDER})::DOUBLE"
    pick = lambda q: f"{drawn('a', q, drawn('b', q, f'c.{q}'))} AS {q}"
    limits, tests = [], []
    for m, (side, k, least, _) in MEASURES.items():
        limits.append(f"max(q50 + {k} * greatest(q50 - q10, {least})) FILTER (measure = '{m}') AS high_{m}")
        tests.append(f"{m} <= high_{m}")
        if side == "both":
            limits.append(f"max(q50 - {k} * greatest(q90 - q50, {least})) FILTER (measure = '{m}') AS low_{m}")
            tests.append(f"{m} >= low_{m}")
    n_in = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return rf"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({n_in(SYMBOLS)})::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, {n_in(UPPER)} AS n_upper, {n_in("!?")} AS n_marks
  FROM base JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
cells AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_share, coalesce(1000 * n_upper // nullif(word_chars, 0), 0) AS upper_share,
  coalesce(1000 * n_marks // nullif(word_chars, 0), 0) AS mark_share, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_share,
  least(coalesce(100 * word_chars // nullif(n_words, 0), 0), 6400) AS word_length FROM counts),
long AS ({unions}),
{quant("own", "lang, source, ")},
{quant("bylang", "lang, ")},
{quant("whole", "")},
picked AS (SELECT a.lang, a.source, a.measure, {pick("q10")}, {pick("q50")}, {pick("q90")} FROM own a
  JOIN bylang b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN whole c ON a.measure = c.measure),
limits AS (SELECT lang, source, {", ".join(limits)} FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept
FROM cells c JOIN limits q ON c.lang IS NOT DISTINCT FROM q.lang AND c.source IS NOT DISTINCT FROM q.source
"""


OP7_SQL = _oracle()
