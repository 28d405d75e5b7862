"""Roll-ups of usage, tool calls, progress and coverage: partial sums, one shuffle of the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.shared import cut


def usage(rows: DataFrame, by: list[str], amounts: list[str], kind: str | None = None) -> DataFrame:
    """Sums, calls and (optionally) the sorted set of kinds of each group."""
    aggs = [F.round(F.sum(a), 2).alias(f"sum_{a}") for a in amounts] + [F.count(F.lit(1)).alias("calls")]
    if kind:
        aggs.append(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"))
    return rows.groupBy(*by).agg(*aggs)


def with_total(rows: DataFrame, by: str, amount: str, total: str = "TOTAL") -> DataFrame:
    """Sum and share of each group with a positive sum, and a total row."""
    rolled = rows.rollup(by).agg(F.round(F.sum(amount), 2).alias("amount"), F.count(F.lit(1)).alias("n"), F.grouping(by).alias("_total"))
    return rolled.filter((F.col("amount") > 0) | (F.col("_total") == 1)).select(F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(by)).alias(by), "amount", "n")


def tool_calls(events: DataFrame, tool: str, kind: str, failed: Column) -> DataFrame:
    """Calls, successes and failures of each tool and in total: started counts calls, completed divides by the error flag, error fails."""
    counts = [
        F.count_if(F.col(kind) == "started").alias("calls"),
        F.count_if((F.col(kind) == "completed") & ~failed).alias("succeeded"),
        F.count_if((F.col(kind) == "error") | ((F.col(kind) == "completed") & failed)).alias("failed"),
    ]
    return events.rollup(tool).agg(*counts, F.grouping(tool).alias("_t")).select(F.when(F.col("_t") == 1, "ALL").otherwise(F.col(tool)).alias(tool), "calls", "succeeded", "failed")


def progress(stages: DataFrame, by: str, done: Column, completed: Column | None = None) -> DataFrame:
    """Done stages in percent, at most 100, and 100 where `completed` holds of any of the group's rows."""
    share = F.least(F.avg(done.cast("double")) * 100, F.lit(100.0))
    percent = share if completed is None else F.when(F.bool_or(F.coalesce(completed, F.lit(False))), F.lit(100.0)).otherwise(share)
    return stages.groupBy(by).agg(F.round(percent, 2).alias("percent"), F.count(F.lit(1)).alias("stages"))


def coverage(rows: DataFrame, column: str, key: str, sample: int = 3) -> DataFrame:
    """Rows with and without a value, and the first keys without one."""
    without = rows.filter(F.col(column).isNull()).orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    counted = rows.agg(F.count_if(F.col(column).isNotNull()).alias("with_value"), F.count_if(F.col(column).isNull()).alias("without_value"))
    return counted.join(F.broadcast(without))


def completed_calls(events: DataFrame, session: str, tool: str, order: str, kind: str) -> DataFrame:
    """Each completion with the last start of its tool in the session before it."""
    w = Window.partitionBy(session, tool).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    started = F.last(F.when(F.col(kind) == "started", F.col(order)), ignorenulls=True).over(w)
    return events.withColumn("started_at", started).filter(F.col(kind) == "completed")


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with their place in an order, from 0: sorted in ranges, numbered within each and shifted by the sizes of those before. No task sorts everything.

    The sorted rows are checkpointed, so that a range keeps its number.
    """
    sorted_rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted_rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each partition
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return sorted_rows.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_range")


def percentiles(rows: DataFrame, score: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Least, greatest and interpolated percentiles of a score, exactly: the rows at the places around each, of a sort by ranges."""
    have = rows.select(F.col(score).cast("double").alias("s")).filter("s IS NOT NULL")
    placed = numbered(have, ["s"], "i")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    spots = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in at])
    near = placed.join(F.broadcast(n)).withColumn("share", F.transform(spots, lambda x: F.greatest(F.lit(0.0), 1 - F.abs(F.col("i") - x))))
    parts = [F.round(F.sum(F.col("share")[k] * F.col("s")), 6).alias(f"p{int(p * 100)}") for k, p in enumerate(at)]
    return near.agg(F.round(F.min("s"), 6).alias("min_score"), F.round(F.max("s"), 6).alias("max_score"), *parts)


def embedding_sizes(rows: DataFrame, vector: str) -> DataFrame:
    """How many vectors there are, and the total and mean of their sizes."""
    n = F.size(vector)
    return rows.filter(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("vectors"), F.sum(n).cast("long").alias("total_size"), F.round(F.avg(n), 3).alias("mean_size"))


def vector_size(rows: DataFrame, vector: str, default: int = 128) -> int:
    """The size of the first vector there is, else the default."""
    first = rows.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return default if first is None else first["n"]


def collection_stats(collections: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """Of each collection: rows, rows with a vector, and a status, `green` if all have one."""
    out = None
    for name, rows in collections.items():
        indexed = F.count_if(F.col(vector).isNotNull()) if vector in rows.columns else F.lit(0)
        one = rows.agg(F.count(F.lit(1)).alias("points"), indexed.cast("long").alias("indexed")).select(F.lit(name).alias("collection"), "points", "indexed", F.when(F.col("points") == F.col("indexed"), "green").otherwise("yellow").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def index_stats(collections: dict[str, DataFrame]) -> list[tuple[str, int, list[str]]]:
    """(collection, number of columns that can be searched, their names and types), from the schemas alone."""
    return [(name, len(df.schema), [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema]) for name, df in sorted(collections.items())]


def community_sizes(membership: DataFrame) -> DataFrame:
    """(community, size, members) of (node, community), members sorted."""
    return membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).alias("members"))
