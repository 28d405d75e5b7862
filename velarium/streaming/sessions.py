"""Structured Streaming jobs over the event table: window counts, idempotent submission, per-session accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from velarium.shared import own_dir, ship


def event_stream(spark: SparkSession, path: str, schema, names: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events; `ts` becomes a TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "7 days", by: str = "event_type") -> DataFrame:
    """Events in tumbling windows; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def once_per_key(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def kept_kinds(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.filter(F.col("event_type").isin(*kinds))


def session_totals(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """Running totals of each session, with the number of type changes, in custom state.

    State is four numbers and a string a session. Rows of a session are ordered by (ts, event_id) inside a micro-batch.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, changes, last = state.get if state.exists else (0, 0.0, 0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, v in zip(rows["event_type"], rows[value], strict=True):
            n, total = n + 1, total + float(v or 0)
            changes += last is not None and kind != last
            last = kind
        state.update((n, total, changes, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "changes": [changes]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, total double, changes long", "n long, total double, changes long, last string", "update", "NoTimeout")


class _Blocks(StatefulProcessor):
    """Open block of each session in value state; a change of type, a gap, or a timer after it closes the block."""

    def __init__(self, key: str, idle: int) -> None:
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("open", "number long, kind string, n long, total double, first long, last long")

    def _closed(self, k: tuple, block: tuple) -> dict:
        number, kind, n, total, first, last = block
        return {self.key: k[0], "number": number, "kind": kind, "n": n, "total": total, "started": pd.Timestamp(first, unit="us"), "ended": pd.Timestamp(last, unit="us")}

    def _due(self, last: int) -> int:
        return (last + self.idle) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        block, out = (tuple(self.block.get()) if self.block.exists() else None), []
        if block is not None:
            self.handle.deleteTimer(self._due(block[5]))
        for kind, at, v in zip(events["event_type"], events["ts"].astype("datetime64[us]").astype("int64"), events["value"], strict=True):
            v = 0.0 if v is None or v != v else float(v)
            if block is not None and block[1] == kind and at - block[5] <= self.idle:
                block = (block[0], kind, block[2] + 1, block[3] + v, block[4], int(at))
            else:
                if block is not None:
                    out.append(self._closed(key, block))
                block = ((block[0] if block is not None else 0) + 1, kind, 1, v, int(at), int(at))
        self.block.update(block)
        self.handle.registerTimer(self._due(block[5]))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.block.exists():
            block = tuple(self.block.get())
            self.block.clear()
            yield pd.DataFrame([self._closed(key, block)])

    def close(self) -> None:
        pass


def session_blocks(events: DataFrame, key: str = "user_id", idle_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Blocks of a session: runs of one type without a gap beyond `idle_seconds`, as (key, number, kind, n, total, started, ended), each when it is closed.

    A change of type or a gap closes a block; so does the watermark once it is past the block's end and the gap, and then the session's state goes (a session that comes back counts its blocks from 1). Needs
    the RocksDB state store (`with_rocksdb`). The rows of a session in one micro-batch are sorted in a task; what is kept between batches is one block a session.
    """
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, number long, kind string, n long, total double, started timestamp, ended timestamp"
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(_Blocks(key, idle_seconds * 1_000_000), schema, "Append", "EventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """State of the session's streams in RocksDB from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the result back.

    `append` writes Parquet in the shared folder; `complete` and `update` write each micro-batch by foreachBatch, tagged by its number.
    """
    import uuid

    at = f"{own_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", at).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(at)

        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(at)
