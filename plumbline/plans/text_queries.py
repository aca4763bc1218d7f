"""Queries of the text expressions, over whole texts of all documents, and of drafts, pooling and streams made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.plans import standins as T
from plumbline.plans.queries import query, r6

#: Letters beyond ASCII as an underscore: DuckDB's word boundaries know ASCII only.
_T = r"t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x{C0}-\x{FF}]', '_', 'g') AS a FROM documents)"


def _texts(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.concat(F.lit("U"), F.col("doc_id")).alias("u"))


@query(
    "b15_numbers",
    rf"""WITH {_T}, n AS (SELECT doc_id, regexp_extract_all(regexp_replace(a, '\d{{4}}-(?:W\d{{1,2}}|\d{{2}}-\d{{2}})', ' ', 'g'), '\b\d+(?:\.\d+)?\b')::DOUBLE[] AS n FROM t)
SELECT doc_id, len(n)::INT AS n_numbers, least(coalesce(list_max(n), 0), 1000000) AS greatest FROM n""",
)
def b15_numbers(spark, sf_dir):
    """Numbers of texts, dates and week labels left out."""
    n = S.numbers_in(F.col("t"))
    return _texts(spark, sf_dir).select("doc_id", F.size(n).alias("n_numbers"), F.least(F.coalesce(F.array_max(n), F.lit(0.0)), F.lit(1e6)).alias("greatest"))


@query(
    "b16_entities",
    rf"""WITH {_T}, e AS (SELECT doc_id, regexp_extract_all(a, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b[A-Z]{{2,}}\d{{2,}}\b') AS e FROM t)
SELECT doc_id, len(e)::INT AS n_entities, md5(array_to_string(e, '|')) AS entities FROM e""",
)
def b16_entities(spark, sf_dir):
    """Title-Case runs and ids in capitals."""
    e = S.entities_in(F.col("t"))
    return _texts(spark, sf_dir).select("doc_id", F.size(e).alias("n_entities"), F.md5(F.array_join(e, "|").cast("binary")).alias("entities"))


@query(
    "b17_main_clause",
    r"""WITH s AS (SELECT doc_id, 'While a (x, y' || CASE WHEN doc_id % 2 = 0 THEN ')' ELSE '' END || ', ' || coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, trim(t, ' ') AS t FROM s),
m AS (SELECT doc_id, t, unnest(string_split(t, '')) AS ch, unnest(range(1, length(t) + 1)) AS i FROM l),
c AS (SELECT doc_id, t, i, ch FROM m WHERE ch IN ('(', ')', ',')),
d AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c),
p AS (SELECT doc_id, min(i) AS place FROM d WHERE ch = ',' AND depth = 0 AND i > 6 AND i < length(t) GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN place IS NULL THEN t ELSE trim(substr(t, place + 1), ' ') END) AS main, md5(CASE WHEN place IS NULL THEN '' ELSE trim(substr(t, 1, place - 1), ' ') END) AS sub FROM l LEFT JOIN p USING (doc_id)""",
)
def b17_main_clause(spark, sf_dir):
    """Main and concessive clause of whole texts after an opener with a bracket that is closed in every second one."""
    opener = F.concat(F.lit("While a (x, y"), F.when(F.col("doc_id") % 2 == 0, ")").otherwise(""), F.lit(", "), F.col("t"))
    d = _texts(spark, sf_dir).withColumn("s", opener)
    return d.select("doc_id", F.md5(S.main_clause(F.col("s")).cast("binary")).alias("main"), F.md5(S.sub_clause(F.col("s")).cast("binary")).alias("sub"))


@query(
    "b20_content_overlap",
    f"""WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}')), lambda x: x NOT IN ({", ".join(repr(x) for x in S.STOP_WORDS)})) AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS x, coalesce(b.w, []) AS y FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS overlap FROM p""",
)
def b20_content_overlap(spark, sf_dir):
    """Content words that a document shares with the next one."""
    d = _texts(spark, sf_dir)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("next"))
    return d.join(after, "doc_id", "left").select("doc_id", r6(S.content_overlap(F.col("t"), F.col("next"))).alias("overlap"))


@query(
    "b21_mentions",
    rf"""WITH {_T} SELECT doc_id, len(regexp_extract_all(a, '(?i)\b(?:he|she|they|his|her|their|him|them)\b'))::INT AS pronouns, ((length(t) - length(replace(t, doc_id % 10 || '.', ''))) // 2)::INT AS ids FROM t""",
)
def b21_mentions(spark, sf_dir):
    """Pronouns, and mentions of an id that holds a pattern character."""
    t = F.col("t")
    return _texts(spark, sf_dir).select("doc_id", S.pronoun_mentions(t).alias("pronouns"), S.id_mentions(t, F.concat(F.col("doc_id") % 10, F.lit("."))).alias("ids"))


@query(
    "b22_name_referents",
    rf"""WITH {_T}, m AS (SELECT doc_id, t, regexp_replace(a, '(?i)\b(?:he|she|they|his|her|their|him|them)\b', 'U' || doc_id, 'g') AS named FROM t)
SELECT doc_id, md5(replace(named, 'U' || doc_id || 's', 'U' || doc_id || '''s')) AS named FROM m""",
)
def b22_name_referents(spark, sf_dir):
    """Pronouns as the user's id (B22); letters beyond ASCII are underscores in what is compared."""
    d = _texts(spark, sf_dir)
    return d.select("doc_id", F.md5(F.regexp_replace(S.name_referents(F.col("t"), F.col("u")), r"[À-ÿ]", "_").cast("binary")).alias("named"))


# The SQL cuts by marks: lookbehinds are two replacements, first of abbreviations' stops, then of places to cut.
@query(
    "b25_sentences",
    rf"""WITH {_T}, x AS (SELECT doc_id, regexp_replace(t, '(?i)((?:^|[^0-9A-Za-z_\x{{C0}}-\x{{FF}}])(?:no|approx|cf|est|avg|max|ca|min)\.)(\s)', '\1' || chr(1) || '\2', 'g') AS t FROM t),
y AS (SELECT doc_id, replace(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+([\p{{Lu}}0-9("''])', '\1' || chr(10) || '\2', 'g'), chr(1), '') AS t FROM x),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda v: trim(v, ' ')), lambda v: v <> '') AS s FROM y)
SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, '|')) AS sentences FROM s""",
)
def b25_sentences(spark, sf_dir):
    """Sentences of texts."""
    s = S.sentences_in(F.col("t"))
    return _texts(spark, sf_dir).select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences"))


@query(
    "b26_scrubbed",
    rf"""WITH {_T} SELECT doc_id, length(regexp_replace(a || ' [R2] R9 2010-W3 12 weeks 3-week', '(?i)\[?\bR\d+\]?|\b\d{{4}}-W\d{{1,2}}\b|\b\d+[- ]?weeks?\b', ' ', 'g'))::INT AS chars FROM t""",
)
def b26_scrubbed(spark, sf_dir):
    """Texts without rule ids, week labels and window lengths."""
    scrubbed = S.scrub_boilerplate(F.concat("t", F.lit(" [R2] R9 2010-W3 12 weeks 3-week")))
    return _texts(spark, sf_dir).select("doc_id", F.length(scrubbed).alias("chars"))
