"""Tables of requests to and answers from outside judges; no call is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



RESPONSE = "request_id string, response struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
ANSWER = "label string, misweighted boolean, numbers array<double>, reason string"


def request_key(model: str, kind: str, *inputs: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(kind), *inputs).cast("binary"))


def _request(ident: Column, prompt: Column, temperature: float) -> Column:
    body = F.struct(F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"))).alias("contents"), F.struct(F.lit(temperature).alias("temperature")).alias("generation_config"))
    return F.to_json(F.struct(ident.alias("request_id"), body.alias("request")))


def generation_requests(contexts: DataFrame, instruction: str, temperature: float = 0.7) -> DataFrame:
    """contexts: signal_id, context. One JSON line per signal."""
    return contexts.select(_request(F.col("signal_id"), F.concat(F.lit(instruction + "\n\n"), F.col("context")), temperature).alias("value"))


def grouping_requests(claims: DataFrame, instruction: str) -> DataFrame:
    """claims of exact pooling. signal_id, the request line with the indexed sentences, and the keys by index."""
    ordered = F.array_sort(F.collect_list(F.struct("sentence_id", "text", "key")))
    lists = claims.groupBy("signal_id").agg(ordered.alias("s"))
    listed = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["text"])), "\n")
    return lists.select("signal_id", _request(F.col("signal_id"), F.concat(F.lit(instruction + "\n\n"), listed), 0.0).alias("value"), F.transform("s", lambda x: x["key"]).alias("keys"))


def scoring_requests(pairs: DataFrame, claims: DataFrame, judgements: DataFrame, model: str) -> DataFrame:
    """Pair, weighting and number requests that no judgement (key_sha1, kind) answers yet; each kind is looked up on its own."""
    entail = pairs.select("premise", "hypothesis").distinct().select(request_key(model, "entailment", F.col("premise"), F.col("hypothesis")).alias("key_sha1"), F.lit("entailment").alias("kind"), F.concat_ws("\n", "premise", "hypothesis").alias("prompt"))
    texts = claims.select("text").distinct()
    single = [texts.select(request_key(model, kind, F.col("text")).alias("key_sha1"), F.lit(kind).alias("kind"), F.col("text").alias("prompt")) for kind in ("weighting", "numbers")]
    wanted = entail.unionByName(single[0]).unionByName(single[1])
    missing = wanted.join(judgements.select("key_sha1", "kind"), ["key_sha1", "kind"], "left_anti")
    return missing.select("key_sha1", "kind", _request(F.col("key_sha1"), F.col("prompt"), 0.0).alias("value"))


def read_responses(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """lines: value (JSON); keys: key_sha1, kind. Answers by key; lines and answers that can't be read are left out, an unknown
    label is neutral, one answer per key stays."""
    parsed = lines.select(F.from_json("value", RESPONSE).alias("r")).select(F.col("r.request_id").alias("key_sha1"), F.get(F.get(F.col("r.response.candidates"), F.lit(0))["content"]["parts"], F.lit(0))["text"].alias("answer"))
    read = parsed.withColumn("a", F.from_json("answer", ANSWER)).filter(F.col("key_sha1").isNotNull() & F.col("a").isNotNull() & F.coalesce("a.label", F.col("a.misweighted").cast("string"), F.col("a.numbers").cast("string")).isNotNull())
    known = F.when(F.lower("a.label").isin("entailment", "contradiction"), F.lower("a.label")).otherwise("neutral")
    joined = read.join(keys, "key_sha1").select("key_sha1", "kind", F.when(F.col("kind") == "entailment", known).alias("label"), "a.misweighted", "a.numbers", "a.reason")
    return joined.groupBy("key_sha1", "kind").agg(F.min(F.struct("label", "misweighted", "numbers", "reason")).alias("x")).select("key_sha1", "kind", "x.*")


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("key_sha1", "kind")) -> DataFrame:
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def draft_key(signal: Column, model: Column, version: Column, temperature: Column) -> Column:
    return F.sha1(F.concat_ws("|", signal, model, version, F.format_string("%.4f", temperature)).cast("binary"))


def stored_drafts(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted: signal_id, model, prompt_version, temperature; cache: key_sha1, payload (JSON array of drafts). Adds drafts; a miss
    or an entry that can't be read is null."""
    keyed = wanted.withColumn("key_sha1", draft_key(F.col("signal_id"), F.col("model"), F.col("prompt_version"), F.col("temperature")))
    return keyed.join(cache, "key_sha1", "left").withColumn("drafts", F.from_json("payload", "array<string>")).drop("payload")


def chunk_of(rows: DataFrame, size: int = 40_000, order: str = "key_sha1") -> DataFrame:
    """Adds a chunk by the key's hash, about `size` rows each, for writers that need named chunks (sinks.write_records has
    max_rows for files)."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("chunk", F.pmod(F.xxhash64(order), F.lit(n)).cast("int"))


