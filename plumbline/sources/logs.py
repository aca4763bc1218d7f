"""Activity logs, directory snapshots, ground truth and records: readers and writers.

Logs are text with a header line per file. Their last field may hold commas and unbalanced quotes, so a line is split at
commas from the left into a fixed number of fields, never parsed as quoted CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Number of fields of each log, and the place of each field that is read.
LOGS: dict[str, tuple[int, dict[str, int]]] = {
    "logon": (5, {"date": 1, "user": 2, "pc": 3, "activity": 4}),
    "device": (6, {"date": 1, "user": 2, "activity": 5}),
    "file": (9, {"date": 1, "user": 2, "filename": 4, "activity": 5, "to_removable_media": 6}),
    "email": (12, {"date": 1, "user": 2, "to": 4, "cc": 5, "bcc": 6, "activity": 8, "attachments": 10}),
    "http": (7, {"date": 1, "user": 2, "url": 4}),
}
DATE_FORMAT = "MM/dd/yyyy HH:mm:ss"


def split_fields(line: Column, log: str) -> list[Column]:
    """The read fields of a line; empty ones are null."""
    n, places = LOGS[log]
    parts = F.split(line, ",", n)
    return [F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(name) for name, k in places.items()]


def parse_lines(lines: DataFrame, log: str) -> DataFrame:
    """lines: value. Adds ts; a date that can't be read gives a null ts (see rejected_rows)."""
    return lines.select(*split_fields(F.col("value"), log)).withColumn("ts", F.try_to_timestamp("date", F.lit(DATE_FORMAT)))


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("ts").isNull()).alias("rejected"))


def read_log(spark: SparkSession, path: str, log: str) -> DataFrame:
    """A log's files; the header line, which is a file's first, begins with `id,date`."""
    return parse_lines(spark.read.text(path).filter(~F.lower("value").startswith("id,date")), log)


def before(events: DataFrame, cutoff: str) -> DataFrame:
    return events.filter(F.col("ts") < F.lit(cutoff).cast("timestamp"))


def first_rows(events: DataFrame, n: int) -> DataFrame:
    """At most n rows of a log, for smoke tests."""
    return events.limit(n)


def without_periods(features: DataFrame, periods: list[str]) -> DataFrame:
    """Rows of other periods. Comes before baselines, as it changes them."""
    return features.filter(~F.col("period").isin(periods))


def read_snapshots(spark: SparkSession, folder: str, files: str = "*.csv") -> DataFrame:
    """Monthly `YYYY-MM.csv` files with their month, or with files="*/*.csv" folders that a month ends the name of; an error if there
    are none."""
    rows = spark.read.option("header", True).csv(f"{folder}/{files}").withColumn("snapshot_month", F.regexp_extract("_metadata.file_path", r"(\d{4}-\d{2})(?:\.csv|/[^/]*)$", 1))
    return rows.filter(F.assert_true(F.col("snapshot_month") != "", F.lit("a snapshot's file name has no month")).isNull())


def read_date_fixes(spark: SparkSession, path: str) -> DataFrame:
    """`{user: {raw: fixed}}` as rows user, raw, fixed."""
    users = spark.read.schema("value string").text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return users.select(F.explode("m").alias("user", "fixes")).select("user", F.explode("fixes").alias("raw", "fixed"))


def truth_windows(answers: DataFrame, release: str, fixes: DataFrame, max_weeks: int = 10) -> DataFrame:
    """Malicious window of each user: answers (dataset, user, scenario, start, end) of a release. A date that can't be read
    needs a fix for (user, raw); without one, or from max_weeks weeks on, the query fails."""
    own = answers.filter(F.col("dataset") == release)
    for c in ("start", "end"):
        fix = fixes.select("user", F.col("raw").alias(c), F.col("fixed").alias(f"_{c}"))
        own = own.join(fix, ["user", c], "left")
        own = own.withColumn(f"{c}_ts", F.coalesce(F.try_to_timestamp(f"_{c}", F.lit(DATE_FORMAT)), F.try_to_timestamp(c, F.lit(DATE_FORMAT))))
    known = F.assert_true(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull(), F.concat(F.lit("no readable date for "), F.coalesce("user", F.lit("?"))))
    own = own.filter(known.isNull())
    out = own.groupBy("user").agg(F.min("start_ts").alias("start"), F.max("end_ts").alias("end"), F.min_by("scenario", "start_ts").alias("scenario"))
    narrow = F.assert_true(F.col("end") < F.timestamp_add("WEEK", F.lit(max_weeks), F.col("start")), F.concat(F.lit("a window is too wide: "), F.col("user")))
    return out.filter(narrow.isNull())


SIGNAL = """signal_id string, user string, period string, period_type string,
 identity struct<employee_name:string,role:string,business_unit:string,functional_unit:string,department:string,team:string,supervisor:string>,
 triggered_rules array<struct<rule_id:string,name:string,description:string>>,
 facts array<struct<fact_id:string,field:string,value:double,display:string,gloss:string,triggering_rule_ids:array<string>,self_center:double,self_z:double,self_z_capped:boolean,self_recent_max:double,never_before:boolean,peer_center:double,peer_z:double,peer_z_capped:boolean,peer_group_size:int>>,
 label struct<is_malicious:boolean,scenario:string>"""
NARRATIVE = """signal_id string, model string, prompt_version string, temperature double, pooling struct<method:string,threshold:double,embed_model:string>,
 temperature_supported boolean, k int, seed bigint, evidence_fact_ids array<string>, narratives array<struct<sample_index:int,text:string,sentence_ids:array<string>>>,
 sentences array<struct<sentence_id:string,text:string,variants:array<string>,n_variants:int,appears_in:array<int>,n_samples:int>>"""


def read_records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a given schema; absent keys are null."""
    return spark.read.schema(schema).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV; Spark drops a byte-order mark itself."""
    return spark.read.option("header", True).csv(path)


def generation_settings(narratives: DataFrame) -> DataFrame:
    """The one combination of model, k, temperature, threshold and version of a run; an error if there are several."""
    one = narratives.select("model", "k", "temperature", F.col("pooling.threshold").alias("threshold"), "prompt_version").distinct()
    return one.withColumn("_n", F.count("*").over(_everything())).filter(F.assert_true(F.col("_n") == 1, F.lit("several settings in one run")).isNull()).drop("_n")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))
