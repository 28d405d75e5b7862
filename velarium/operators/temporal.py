"""Timed rows: overlap joins, neighbours, shots, cumulative segments, batches, timelines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from velarium.functions.timecode import overlaps
from velarium.shared import ship


def overlap_join(left: DataFrame, right: DataFrame, on: str, bucket: float, start: str = "start_sec", end: str = "end_sec", prefix: str = "r_") -> DataFrame:
    """Pairs of rows with equal `on` whose intervals overlap.

    Both sides are dealt to time buckets of `bucket` seconds and joined on (on, bucket), so that a long timeline spreads over tasks; a pair is kept only
    in the first bucket that both touch.
    """
    buckets = lambda a, b: F.sequence(F.floor(a / bucket), F.floor(b / bucket))
    a = left.withColumn("_bucket", F.explode(buckets(F.col(start), F.col(end))))
    renamed = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    b = renamed.withColumn("_b", F.explode(buckets(F.col(prefix + start), F.col(prefix + end))))
    pair = (F.col(on) == F.col(prefix + on)) & (F.col("_bucket") == F.col("_b"))
    first = F.floor(F.greatest(F.col(start), F.col(prefix + start)) / bucket)
    hit = overlaps(F.col(start), F.col(end), F.col(prefix + start), F.col(prefix + end))
    return a.join(b, pair).filter((F.col("_bucket") == first) & hit).drop("_bucket", "_b")


def around(rows: DataFrame, start: float, end: float, window: float, duration: float | None = None) -> DataFrame:
    """Rows that overlap [start - window, end + window]; a given duration demands 0 <= start < end <= duration."""
    if duration is not None and not 0 <= start < end <= duration:
        raise ValueError(f"no valid range: {start} to {end} of {duration}")
    return rows.filter(overlaps(F.col("start_sec"), F.col("end_sec"), F.lit(max(0.0, start - window)), F.lit(end + window))).orderBy("start_sec")


def neighbours(rows: DataFrame, pivot_start, pivot_end, hop: int = 1, forward: bool = True, include_range: bool = True, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """The next `hop` segments after (before) a pivot, or just the hop-th; with fewer rows the first stands for it. The pivot is not its own neighbour."""
    side = rows.filter(F.col(start) >= pivot_end) if forward else rows.filter(F.col(end) <= pivot_start)
    order = [F.col(start).asc(), F.col(key)] if forward else [F.col(end).desc(), F.col(key)]
    near = side.orderBy(*order).limit(hop).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    if include_range:
        return near
    n = near.agg(F.count(F.lit(1)).alias("_n"))
    return near.join(F.broadcast(n)).filter(F.col("rank") == F.when(F.col("_n") < hop, F.lit(1)).otherwise(F.lit(hop))).drop("_n")


def neighbour_images(rows: DataFrame, pivot: int, hop: int = 1, forward: bool = True, include_range: bool = True, key: str = "key", frame: str = "frame_index") -> DataFrame:
    """As `neighbours`, for points: the pivot's own frame is included."""
    side = rows.filter(F.col(frame) >= pivot) if forward else rows.filter(F.col(frame) <= pivot)
    order = [F.col(frame).asc() if forward else F.col(frame).desc(), F.col(key)]
    near = side.orderBy(*order).limit(hop).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    if include_range:
        return near
    n = near.agg(F.count(F.lit(1)).alias("_n"))
    return near.join(F.broadcast(n)).filter(F.col("rank") == F.when(F.col("_n") < hop, F.lit(1)).otherwise(F.lit(hop))).drop("_n")


def next_edges(rows: DataFrame, by: str, order: list[str], start: str, end: str, key: str) -> DataFrame:
    """Each row with its successor: src, dst, gap (0 at least)."""
    w = Window.partitionBy(by).orderBy(*order)
    out = rows.select(by, F.col(key).alias("src"), F.lead(key).over(w).alias("dst"), F.greatest(F.lead(start).over(w) - F.col(end), F.lit(0.0)).alias("gap"))
    return out.filter(F.col("dst").isNotNull())


def shots(frames: DataFrame, by: str, index: str, boundary: Column) -> DataFrame:
    """Shots between boundary frames: (by, shot, first, last).

    A shot is a run of frames without a boundary and ends at the index of the next boundary frame, or at the last index; a leading boundary opens
    nothing; a group without a run is one shot over all its frames.
    """
    w = Window.partitionBy(by).orderBy(index)
    flagged = frames.select(by, F.col(index).alias("i"), F.coalesce(boundary.cast("int"), F.lit(0)).alias("cut"))
    runs = flagged.withColumn("run", F.sum("cut").over(w)).withColumn("next_cut", F.first(F.when(F.col("cut") == 1, F.col("i")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = flagged.groupBy(by).agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("cut").alias("some"))
    islands = runs.filter("cut = 0").groupBy(by, "run").agg(F.min("i").alias("first"), F.max(F.coalesce("next_cut", "i")).alias("last"))
    whole = ends.filter("some = 1").select(by, F.lit(0).alias("run"), F.col("lo").alias("first"), F.col("hi").alias("last"))
    every = islands.unionByName(whole)
    return every.select(by, F.row_number().over(Window.partitionBy(by).orderBy("first")).alias("shot"), "first", "last")


def resetting_groups(rows: DataFrame, by: str, order: list[str], amount: str, least: float, carry: list[str]) -> DataFrame:
    """Number rows by cumulative groups: a group closes with the row that brings its sum to `least`; the rest is a group as well.

    Timelines are dealt by their key and sorted in the shuffle; one pass goes over the sorted rows with a sum and a number as its state, so a timeline may be of any length.
    """
    ship(rows.sparkSession)
    kept = list(dict.fromkeys([*order, *carry]))
    narrow = rows.select(by, F.col(amount).cast("double").alias(amount), *[c for c in kept if c not in (by, amount)])
    out = StructType([StructField("segment", IntegerType()), *narrow.schema.fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, segment, begun = None, 0.0, 0, False
        for batch in batches:
            numbers = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or key != group:
                    group, total, segment, begun = key, 0.0, 0, True
                numbers.append(segment)
                total += x or 0.0
                if total >= least:
                    total, segment = 0.0, segment + 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *batch.columns], names=["segment", *batch.schema.names])

    found = narrow.repartition(by).sortWithinPartitions(by, *order).mapInArrow(number, out)
    return found.select(by, "segment", amount, *[c for c in kept if c not in (by, amount)])


def merged_segments(grouped: DataFrame, by: str, start: str, end: str, text: str | None = None, order: str | None = None) -> DataFrame:
    """First start, last end and joined text of each segment of `resetting_groups`."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(start).alias("start"), F.max(end).alias("end")]
    if text:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"))
    return grouped.groupBy(by, "segment").agg(*aggs)


def hop_batches(n: int, size: int = 100, stride: int = 50, pad: int = 25) -> list[tuple[int, int]]:
    """Frame ranges of overlapping batches over n frames padded by `pad` in front and to a multiple of the stride behind; the middle of each is kept."""
    padded = pad + n + (-n % stride) + pad
    return [(s - pad, s - pad + size) for s in range(0, padded - size + 1, stride)]


def batch_rows(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Number consecutive rows by batches of `size`."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("long"))


def hop_windows(rows: DataFrame, index: Column, size: int, stride: int) -> DataFrame:
    """Each row in every window [w * stride, w * stride + size) that holds its index."""
    first = F.greatest(F.floor((index - size) / stride) + 1, F.lit(0))
    return rows.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(index / stride).cast("long"))))


def minute_timeline(rows: DataFrame, by: str, start: str, caption: str, key: str) -> DataFrame:
    """Rows of each minute and the caption of its earliest."""
    first = F.min_by(caption, F.struct(start, key))
    return rows.groupBy(by, F.floor(F.col(start) / 60).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("n"), first.alias("caption"))


def runs_merged(rows: DataFrame, by: str, order: list[str], kinds: list[str], text: str) -> DataFrame:
    """Consecutive rows of equal kinds become one: (by, run, kinds, n, text joined in order)."""
    w = Window.partitionBy(by).orderBy(*order)
    same = F.lit(True)
    for k in kinds:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    numbered = rows.withColumn("_new", F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")))), lambda x: x["_t"]), "")
    return numbered.groupBy(by, "run", *kinds).agg(F.count(F.lit(1)).alias("n"), joined.alias("text"))


def batch_of_range(rows: DataFrame, index: str, first_batch: int, last_batch: int, size: int) -> DataFrame:
    """Rows of the batches first to last, [first * size, (last + 1) * size) of a dense index; a range beyond the rows ends with them."""
    return rows.filter((F.col(index) >= first_batch * size) & (F.col(index) < (last_batch + 1) * size))


def ranges_joined(ranges: DataFrame, rows: DataFrame, index: str, size: int) -> DataFrame:
    """Each range (from_batch, to_batch, ...) with its rows: the ranges' batches are an equi-join on the rows' batch number."""
    spread = ranges.withColumn("_batch", F.explode(F.sequence("from_batch", "to_batch")))
    return spread.join(rows.withColumn("_batch", F.floor(F.col(index) / size).cast(ranges.schema["from_batch"].dataType)), "_batch").drop("_batch")
