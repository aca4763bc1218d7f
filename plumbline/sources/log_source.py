"""Positional logs as a Python data source that takes bounds on the time and reads the wanted columns only.

`scan_log` reads what `logs.read_log` reads, with the same rules: a line is split at commas from the left, empty fields are null, a date
that can't be read gives a null ts, header lines begin with `id,date`. Files are cut into ranges of bytes; a line belongs to the range it starts in.
Comparisons of ts with constants are taken over from Spark: rows outside never leave the reader. Where `ordered` says that each
file is in the order of its dates, ranges outside the bounds are not planned at all (a few dates are looked up per file, by halving), and a
range is left at the first piece beyond the upper bound. Work inside a range is done on Arrow columns.

Defined results: empty files and folders without files give no rows; lines of any length are read whole; bytes that are no UTF-8 become replacement characters;
wall-clock times that a clock change repeats are the earlier ones. Stores that Arrow can't open are read by `logs.read_log`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from plumbline.sources.logs import LOGS, read_log

#: Bytes of a range, and of a piece that is parsed at a time.
RANGE, PIECE = 64 << 20, 4 << 20
SCHEMES = ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")
_SHAPE = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"
_OPS = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", EqualTo: "="}


def parse_times(dates: pa.Array, zone: str) -> pa.Array:
    """Instants of MM/dd/yyyy HH:mm:ss wall-clock times; null where there is no such time."""
    shaped = pc.fill_null(pc.match_substring_regex(dates, _SHAPE), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(shaped)
    digits = np.frombuffer("".join(dates.take(pa.array(at)).to_pylist()).encode(), np.uint8).reshape(-1, 19).astype(np.int64) - 48
    two = lambda k: digits[:, k] * 10 + digits[:, k + 1]
    month, day, year, hour, minute, second = two(0), two(3), two(6) * 100 + two(8), two(11), two(14), two(17)
    first = ((year - 1970) * 12 + np.clip(month, 1, 12) - 1).astype("M8[M]")
    length = ((first + 1).astype("M8[D]") - first.astype("M8[D]")).astype(np.int64)
    good = (year > 0) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= length) & (hour < 24) & (minute < 60) & (second < 60)
    seconds = (first.astype("M8[D]").astype(np.int64) + day - 1) * 86400 + hour * 3600 + minute * 60 + second
    micros, known = np.zeros(len(dates), np.int64), np.zeros(len(dates), bool)
    micros[at], known[at] = seconds * 1_000_000, good
    return pc.assume_timezone(pa.array(micros, pa.timestamp("us"), mask=~known), zone, ambiguous="earliest", nonexistent="latest")


def parse_fields(lines: pa.Array, log: str, names: Iterable[str]) -> dict[str, pa.Array]:
    """Fields of lines by name; absent and empty ones are null."""
    n, places = LOGS[log]
    parts = pc.split_pattern(lines, ",", max_splits=n - 1)
    offsets, flat, out = parts.offsets.to_numpy(), parts.values, {}
    for name in names:
        at = offsets[:-1] + places[name]
        field = flat.take(pa.array(at, mask=at >= offsets[1:]))
        out[name] = pc.if_else(pc.equal(field, ""), pa.scalar(None, field.type), field)
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.uri, self.log, self.zone, self.columns = options["path"], options["log"], options.get("zone", "UTC"), columns
        self.ordered, self.range = options.get("ordered", "false").lower() == "true", int(options.get("range", RANGE))
        self.bounds: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _OPS and f.attribute == ("ts",) and isinstance(f.value, datetime):
                value = f.value if f.value.tzinfo else f.value.astimezone()
                self.bounds.append((_OPS[type(f)], (value.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // _MICRO))
            elif not (isinstance(f, IsNotNull) and f.attribute == ("ts",)):
                yield f
            else:
                self.bounds.append(("known", 0))

    def limits(self) -> tuple[int | None, int | None]:
        """The least instant that the bounds let in, and the first beyond them."""
        low = [b + (op == ">") for op, b in self.bounds if op in (">", ">=", "=")]
        high = [b + (op != "<") for op, b in self.bounds if op in ("<", "<=", "=")]
        return max(low, default=None), min(high, default=None)

    def partitions(self) -> list[Range]:
        store, path = pf.FileSystem.from_uri(self.uri)
        found = store.get_file_info(path)
        files = [found] if found.is_file else store.get_file_info(pf.FileSelector(path, recursive=True))
        low, high = self.limits()
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.is_file or not f.size or f.base_name[0] in "_.":
                continue
            ranges = [Range(f.path, a, min(a + self.range, f.size)) for a in range(0, f.size, self.range)]
            if self.ordered and len(ranges) > 1 and (low is not None or high is not None):
                first, last = 0, len(ranges)
                if high is not None:  # ranges that begin beyond the upper bound go
                    last = self._split(store, ranges, high)
                if low is not None:  # ranges whose successor still begins below the lower bound go
                    first = max(0, self._split(store, ranges, low) - 1)
                ranges = ranges[first:last]
            out += ranges
        return out

    def _split(self, store: pf.FileSystem, ranges: list[Range], instant: int) -> int:
        """Number of leading ranges that begin before the instant. A range without a readable date says nothing: its successors are asked."""
        low, high = 0, len(ranges)
        while low < high:
            middle = asked = (low + high) // 2
            begins = None
            while begins is None and asked < high:
                begins = self._begins(store, ranges[asked])
                asked += begins is None
            if begins is None or begins >= instant:
                high = middle
            else:
                low = asked + 1
        # undated ranges just before the boundary may hold nothing of interest, but are kept
        while low < len(ranges) and self._begins(store, ranges[low]) is None:
            low += 1
        return low

    def _begins(self, store: pf.FileSystem, part: Range) -> int | None:
        for lines in self._lines(store, part, 1 << 14):
            times = parse_times(parse_fields(lines, self.log, ["date"])["date"], self.zone).drop_null()
            if len(times):
                return times[0].value
        return None

    def _lines(self, store: pf.FileSystem, part: Range, piece: int) -> Iterator[pa.Array]:
        """Lines that start in the range, without headers, a piece at a time."""
        with store.open_input_file(part.path) as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at -= 1
                while True:  # to the end of the line before
                    block = f.read(1 << 16)
                    if not block:
                        return
                    cut = block.find(b"\n")
                    if cut >= 0:
                        at += cut + 1
                        break
                    at += len(block)
            f.seek(at)
            held: list[bytes] = []
            while at < part.stop:
                block = f.read(min(piece, max(part.stop - at, 1 << 12)) if not held else piece)
                cut = block.rfind(b"\n") + 1
                if block and at + sum(map(len, held)) + len(block) >= part.stop:
                    # the last line of the range ends at the first line break at or after its last byte
                    cut = block.find(b"\n", max(part.stop - 1 - at - sum(map(len, held)), 0)) + 1 or 0
                if block and not cut:
                    held.append(block)
                    continue
                data = b"".join([*held, block[:cut]]) if block else b"".join(held)
                held = [block[cut:]] if block[cut:] else []
                at += len(data)
                if data:
                    yield self._array(data)
                if not block:
                    return

    def _array(self, data: bytes) -> pa.Array:
        text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        lines = pa.array(text.removesuffix("\n").split("\n"), pa.string())
        return lines.filter(pc.invert(pc.starts_with(lines, "id,date", ignore_case=True)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = pf.FileSystem.from_uri(self.uri)
        low, high = self.limits()
        fields = [c for c in self.columns if c != "ts"]
        timed = bool(self.bounds) or "ts" in self.columns
        for lines in self._lines(store, partition, PIECE):
            parsed = parse_fields(lines, self.log, {*fields, "date"} if timed else fields)
            if timed:
                parsed["ts"] = parse_times(parsed["date"], self.zone)
            out = pa.RecordBatch.from_arrays([parsed[c] for c in self.columns], names=self.columns)
            beyond = False
            if self.bounds:
                known = parsed["ts"].is_valid().to_numpy(zero_copy_only=False)
                micros = parsed["ts"].cast(pa.int64()).fill_null(0).to_numpy()
                keep = known & (micros >= (low if low is not None else micros)) & ((micros < high) if high is not None else True)
                out = out.filter(pa.array(keep))
                beyond = self.ordered and high is not None and bool((known & (micros >= high)).any())
            yield out
            if beyond:
                return


_MICRO = datetime(1970, 1, 1, 0, 0, 0, 1) - datetime(1970, 1, 1)


class LogSource(DataSource):
    """Format `positional_log`; options path, log, zone (of the wall clock), ordered, range (bytes). A given schema names the columns to read."""

    @classmethod
    def name(cls) -> str:
        return "positional_log"

    def schema(self) -> str:
        return ", ".join([*(f"{c} string" for c in LOGS[self.options["log"]][1]), "ts timestamp"])

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options), schema.fieldNames())


def scan_log(spark: SparkSession, path: str, log: str, columns: list[str] | None = None, ordered: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """A log's files with the given columns (all, and ts, if None); ordered: each file is in the order of its dates."""
    if path.partition("://")[0] not in SCHEMES and "://" in path or path.startswith("file:") and not path.startswith("file:///"):
        found = read_log(spark, path, log)
        return found if columns is None else found.select(*columns)
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("positional_log").option("log", log).option("zone", spark.conf.get("spark.sql.session.timeZone")).option("ordered", ordered).option("range", range_bytes)
    if columns is not None:
        reader = reader.schema(", ".join(f"{c} {'timestamp' if c == 'ts' else 'string'}" for c in columns))
    return reader.load(path)
