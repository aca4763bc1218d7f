"""Writers: records, features, summaries, and the rules that keep good output safe.

An output is a folder of versions, `v-...` each, and a small pointer file that names the one to read. A job writes a version of its own beside the
others; only when it has ended well is the pointer replaced, in one rename. So readers always see a whole output, and a job that
fails or finds nothing leaves the one there as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def pooling_slug(method: str, threshold: float | None = None) -> str:
    """`exact`, or `t085` for a threshold of 0.85: two thresholds never share a path."""
    return "exact" if method == "exact" else f"t{round(threshold * 100):03d}"


def output_path(base: str, method: str, threshold: float | None = None) -> str:
    return f"{base.rstrip('/')}/{pooling_slug(method, threshold)}"


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str:
    """Where the output's present version is."""
    fs, at = _hadoop(spark, f"{path}/{POINTER}")
    stream = fs.open(at)
    try:
        return f"{path}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def is_written(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, f"{path}/{POINTER}")
    return fs.exists(at)


def _publish(spark: SparkSession, path: str, version: str) -> None:
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    fs, made = _hadoop(spark, f"{path}/.{version}")
    stream = fs.create(made, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), context._jsc.hadoopConfiguration()).rename(made, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)


def write_records(df: DataFrame, path: str, kind: str = "json", max_rows: int = 0, empty: bool = False) -> str:
    """JSON lines, Parquet or CSV, at most max_rows rows a file if given; read it from current(spark, path), which is returned. With nothing
    to write, the output there stays and it is an error, unless `empty` allows it. The plan runs once: rows are counted as they are written."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    rows = Observation()
    writer = df.observe(rows, F.count(F.lit(1)).alias("n")).write
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(f"{path}/{version}")
    if not rows.get["n"] and not empty:
        fs, own = _hadoop(spark, f"{path}/{version}")
        fs.delete(own, True)  # this call's own version, without a row
        raise ValueError(f"no records for {path}: the output there stays")
    _publish(spark, path, version)
    return f"{path}/{version}"


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the present one, those of failed jobs too; how many. Not for times when others write or read older ones."""
    fs, at = _hadoop(spark, path)
    kept = current(spark, path).rsplit("/", 1)[1]
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v-") and s.getPath().getName() != kept]
    for p in old:
        fs.delete(p, True)
    return len(old)


def resumed(spark: SparkSession, path: str, build) -> DataFrame:
    """The finished table at path, else build() written there."""
    if not is_written(spark, path):
        write_records(build(), path, "parquet", empty=True)
    return spark.read.parquet(current(spark, path))
