"""Pieces that several operators share: word splitting, table reading, vectors as matrices; durable intermediate results are those of the library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.durable import durable, gathered, parts_of, shared_folder, small  # noqa: F401  for the operators of this folder

#: What separates words: space, and tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For Python's str.translate: A-Z only, unlike str.lower.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null, NaN or infinite entry."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def matrix(column, dims: int, fill: int = 0) -> np.ndarray:
    """An Arrow column of number lists, without nulls, as rows of dims entries; shorter ones are filled up at their end."""
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.full((len(lengths), dims), fill, flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def crc_mod(doc_id: Column, n: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n
