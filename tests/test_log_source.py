"""The log source against the plain reader: any cut into ranges, bounds, columns, odd lines."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan, StringContains

from plumbline.sources import log_source as L
from plumbline.sources import logs

HEAD = "id,date,user,pc,url,activity,content\n"


def line(k: int, r: random.Random) -> str:
    at = datetime(2010, 1, 2) + timedelta(minutes=7 * k)
    return f'{{{k}}},{at:%m/%d/%Y %H:%M:%S},U{k % 5},PC-{k % 3},http://a{k % 9}.com/é,{"WWW" if k % 4 else ""},say "{"a, b " * r.randint(0, 30)}\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, at = random.Random(3), tmp_path_factory.mktemp("http")
    for n in range(3):
        rows = [line(k, r) for k in range(400 * n, 400 * n + 400)]
        rows[7], rows[8], rows[200] = "short,line\n", "\n", "{x},02/30/2010 00:00:00,U1,PC-1,http://z.com,WWW," + "long " * 20_000 + "\n"
        (at / f"{n}.csv").write_text(HEAD + "".join(rows)[: -1 if n == 2 else None], newline="\r\n" if n == 1 else "\n")
    (at / "empty.csv").write_text("")
    (at / "_SUCCESS").write_text("")
    return str(at)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("size", [1_000, 50_000, L.RANGE])
def test_same_rows_as_the_plain_reader(spark, folder, size):
    want, got = logs.read_log(spark, folder, "http"), L.scan_log(spark, folder, "http", range_bytes=size)
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("ordered", [False, True])
def test_bounds_and_columns(spark, folder, ordered):
    want, got = logs.read_log(spark, folder, "http"), L.scan_log(spark, folder, "http", ["user", "ts"], ordered, 5_000)
    bounds = [F.col("ts") < F.lit("2010-01-05 03:00:00").cast("timestamp"), F.col("ts") >= F.lit("2010-01-03 07:07:00").cast("timestamp")]
    for some in (bounds[:1], bounds[1:], bounds, [F.col("ts") == F.lit("2010-01-03 07:04:00").cast("timestamp")], [F.col("ts").isNull()], [F.col("user") == "U2", bounds[0]]):
        a, b = want.select("user", "ts"), got
        for condition in some:
            a, b = a.filter(condition), b.filter(condition)
        assert rows(a) == rows(b) and (len(rows(a)) or some is not bounds)
    assert rows(logs.before(want, "2010-01-05").select("user", "ts")) == rows(logs.before(got, "2010-01-05"))


def test_ranges_beyond_the_bounds_are_not_planned(spark, folder):
    def planned(ordered, *filters):
        reader = L.LogReader({"path": f"{folder}/0.csv", "log": "http", "ordered": str(ordered), "range": "5000"}, ["user"])
        left = list(reader.pushFilters(list(filters)))
        return len(reader.partitions()), left

    low, high = datetime(2010, 1, 2, 6).astimezone(L.UTC), datetime(2010, 1, 2, 9).astimezone(L.UTC)
    every, _ = planned(True)
    other = StringContains(("user",), "U")
    few, left = planned(True, LessThan(("ts",), high), GreaterThanOrEqual(("ts",), low), other)
    assert left == [other] and 1 <= few <= every // 5
    assert planned(False, LessThan(("ts",), high))[0] == every
    bounded = logs.before(L.scan_log(spark, f"{folder}/0.csv", "http", ordered=True, range_bytes=5_000), "2010-01-02 09:00:00")
    assert "Filter (" not in bounded._jdf.queryExecution().executedPlan().toString()  # the reader took the bound over
    assert bounded.rdd.getNumPartitions() < every


def test_impossible_times(spark):
    import pyarrow as pa

    dates = ["02/29/2012 23:59:59", "02/29/2011 00:00:00", "13/01/2010 00:00:00", "1/2/2010 00:00:00", "01/02/2010 24:00:00", "00/10/2010 00:00:00", None, "", "12/31/2010 00:00:60"]
    want = spark.createDataFrame([(d,) for d in dates], "d string").select(F.unix_micros(F.try_to_timestamp("d", F.lit(logs.DATE_FORMAT))).alias("t"))
    assert [x.value for x in L.parse_times(pa.array(dates), "UTC")] == [r.t for r in want.collect()]


def test_stores_that_arrow_cannot_open(spark, folder):
    got = L.scan_log(spark, f"file:{folder}", "http", ["user"])
    assert got.count() == logs.read_log(spark, folder, "http").count()
