"""The event log: an append-only stream of JSON lines, its state by key, and the emitter that holds rows back behind a gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

EVENT = "event string, data map<string,string>, ts string"
HELD_STATE = StructType([StructField("seq", LongType()), StructField("row", StringType())])


def tail(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the log since the last checkpoint; lines that do not parse are skipped."""
    lines = spark.readStream.text(path)
    parsed = lines.select(F.from_json("value", EVENT).alias("e"))
    return parsed.where("e.event IS NOT NULL").select("e.event", "e.data", F.try_to_timestamp("e.ts").alias("ts"))


def append(events: DataFrame, path: str, checkpoint: str):
    """Writes a stream to the log as JSON lines, what is there once; ends when all has been read."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events per time window and key; windows close when the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; of equal ones that with the larger ``order`` columns."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def emitted_order(rows: DataFrame, key: str, seq: str, held: Column, gate: Column) -> DataFrame:
    """Batch twin of the emitter: ``emitted`` numbers the rows of a key as they come out.

    Held rows before the key's first gate row come right after it in order; without a gate row they come last.
    """
    w = Window.partitionBy(key)
    end = F.coalesce(F.min(F.when(gate, F.col(seq))).over(w), F.lit(1 << 62))
    rows = rows.withColumns({"_gate": end, "_held": F.coalesce(held, F.lit(False))})
    waits = F.col("_held") & (F.col(seq) < F.col("_gate"))
    order = [F.when(waits, F.col("_gate")).otherwise(F.col(seq)), F.when(waits, 1).otherwise(0), F.col(seq)]
    return rows.withColumn("emitted", F.row_number().over(w.orderBy(*order)).cast("long")).drop("_gate", "_held")


class GatedEmitter(StatefulProcessor):
    """Emits rows of other kinds at once, and held rows in order once the gate has come; with ``patience_ms`` a timer flushes keys without one."""

    def __init__(self, held: str, gate: str, patience_ms: int | None = None) -> None:
        self.held, self.gate, self.patience_ms = held, gate, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", HELD_STATE)
        self.is_open = handle.getValueState("is_open", "open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        is_open = bool(self.is_open.exists() and self.is_open.get()[0])
        out, waiting = [], []
        for seq, kind, row in sorted((r for frame in rows for r in frame[["seq", "kind", "row"]].itertuples(index=False, name=None)), key=lambda r: r[0]):
            if kind == self.held and not is_open:
                waiting.append((int(seq), row))
                continue
            out.append((int(seq), row))
            if kind == self.gate and not is_open:
                is_open = True
                out += sorted([*((int(s), r) for s, r in self.waiting.get()), *waiting])
                waiting = []
                self.waiting.clear()
                self.is_open.update((True,))
        if waiting:
            if self.patience_ms is not None and not self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            self.waiting.appendList(waiting)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = sorted((int(s), r) for s, r in self.waiting.get()) if self.waiting.exists() else []
        self.waiting.clear()
        yield self._frame(key, out)

    def _frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(out), "seq": pd.Series([s for s, _ in out], dtype="int64"), "row": [r for _, r in out]})

    def close(self) -> None:
        pass


def gated(stream: DataFrame, held: str, gate: str, patience_ms: int | None = None) -> DataFrame:
    """``stream``: key string, seq long, kind string, row string. Needs the RocksDB state store.

    With ``patience_ms`` the query has processing-time timers; such a query goes on until it is stopped, also with availableNow.
    """
    mode = "None" if patience_ms is None else "ProcessingTime"
    return stream.groupBy("key").transformWithStateInPandas(GatedEmitter(held, gate, patience_ms), outputStructType="key string, seq long, row string", outputMode="Append", timeMode=mode)
