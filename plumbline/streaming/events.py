"""Weekly features from a stream of events, and an acceptance threshold that adapts batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions import scalars as S
from plumbline.operators.calibration import POLICIES


def weekly_counts(events: DataFrame, late: str = "14 days", approximate: bool = True) -> DataFrame:
    """events (a stream or a table): user_id, ts, event_type, value. Per user and Monday week: events, after-hours events, value,
    distinct types. Streams need the approximate distinct count, whose state has a fixed size; events later than `late` are
    dropped there."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    kinds = F.approx_count_distinct("event_type") if approximate else F.count_distinct("event_type")
    week = F.window("ts", "7 days", "7 days", "4 days")
    made = timed.groupBy(week.alias("w"), "user_id").agg(F.count("*").alias("events"), F.count_if(S.after_hours(F.col("ts"))).alias("after_hours_events"), F.sum("value").alias("value"), kinds.alias("event_types"))
    return made.select("user_id", F.col("w.start").alias("week_start"), "events", "after_hours_events", "value", "event_types")


class _Threshold(StatefulProcessor):
    """State of a stream: lambda, and for each period that is still open how many claims, and how many wrong ones, have each score."""

    def __init__(self, wrong: tuple[str, ...], alpha: float, gamma: float, start: float):
        self.wrong, self.alpha, self.gamma, self.start = wrong, alpha, gamma, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lam = handle.getValueState("lam", "lam double")
        self.open = handle.getMapState("open", "closes long", "period string")
        self.counts = handle.getMapState("counts", "closes long, score double", "n long, w long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf.assign(closes=pdf["closes"].astype("datetime64[ms]").astype("int64"), w=pdf["label"].isin(self.wrong))
            pdf = pdf[pdf["closes"] > now]  # a closed period stays as it is
            for closes, period in pdf.groupby("closes")["period"].first().items():
                if not self.open.containsKey((closes,)):
                    self.open.updateValue((closes,), (period,))
                    self.handle.registerTimer(closes)
            scored = pdf[pdf["score"].notna()].groupby(["closes", "score"])["w"].agg(["size", "sum"])
            for cell, n, w in zip(scored.index, scored["size"], scored["sum"]):
                old = self.counts.getValue(cell) or (0, 0)
                self.counts.updateValue(cell, (old[0] + int(n), old[1] + int(w)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over = sorted((c, p) for (c,), (p,) in self.open.iterator() if c <= now)  # all that the watermark has passed, in order
        if not over:  # an earlier timer of this trigger has closed them
            yield pd.DataFrame()
            return
        sums: dict[int, list] = {c: [] for c, _ in over}
        for (closes, score), (n, w) in self.counts.iterator():
            if closes in sums:
                sums[closes].append((score, n, w))
        lam = self.lam.get()[0] if self.lam.exists() else self.start
        out = []
        for closes, period in over:
            taken = sum(n for score, n, _ in sums[closes] if score >= lam)
            wrong = sum(w for score, _, w in sums[closes] if score >= lam)
            err = float(wrong) / max(float(taken), 1.0)
            if sums[closes]:  # as in a table, a period without a score is none
                out.append((*key, period, lam, err))
                lam = max(0.0, min(1.0, lam + self.gamma * (err - self.alpha)))
            self.open.removeKey((closes,))
            for score, _, _ in sums[closes]:
                self.counts.removeKey((closes, score))
        self.lam.update((lam,))
        yield pd.DataFrame(out, columns=["stream_id", "period", "lambda", "err"])

    def close(self) -> None:
        pass


def adaptive_threshold(claims: DataFrame, late: str = "14 days", policy: str = "primary", alpha: float = 0.10, gamma: float = 0.05, start: float = 0.90) -> DataFrame:
    """claims (a stream): stream_id, period, closes (timestamp at which the period ends), score, label. Counts of open periods stand in the
    state; a period is closed, and lambda moves, when the watermark, `late` behind the last end seen, has passed its end, so it does not
    matter how rows are spread over triggers. Rows of closed periods are dropped. A row without a score only moves the watermark. Rows: stream_id,
    period, lambda (in force for it), err, as adaptive_thresholds gives them for a table. Needs the RocksDB state store (see run_to_end)."""
    timed = claims.withColumn("closes", F.col("closes").cast("timestamp")).withWatermark("closes", late)
    return timed.groupBy("stream_id").transformWithStateInPandas(_Threshold(POLICIES[policy], alpha, gamma, start), "stream_id string, period string, lambda double, err double", "Append", "EventTime")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, to Parquet. In complete mode each trigger's whole result replaces the last one's. State stands in RocksDB, on disk."""
    stream.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
