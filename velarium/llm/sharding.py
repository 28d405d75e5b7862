"""Consistent-hash sharding with bounded loads, in DataFrame operations only.

The ring has `ring_slots` places. Every shard owns `vnodes` virtual nodes on it; a row's place is the XXH64 of its id and
of the CRC-32 of its text. A row belongs to the first virtual node at or after its place; a shard takes rows up to its bound,
and the rows beyond it go on clockwise to the next virtual node whose shard has room. The bounds are the row count over
the shard count, rounded so that they sum to the rows: counts differ by one at most (law `rows`).

Only the counts by ring place reach the driver (`ring_slots` rows, whatever the input); they give runs of ranks
(place, first rank, shard), which are broadcast. Ranks inside a place come from windows over chunks of bounded size, so
that a place, or one id repeated by a third of the rows, is spread over tasks. Rows with equal id and text are interchangeable.

Null texts have size 8 and the CRC-32 of the empty text; null ids are placed like any other. Rows that repeat both id and text get slots of their own. Texts of any length count by all their bytes.
Columns other than id and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velarium.shared import cut

RUNS = "place int, lo long, hi long, shard int, base long"


def place_nodes(spark, shards: int, vnodes: int, ring_slots: int) -> list[tuple[int, int]]:
    """(ring place, shard) of every virtual node, clockwise; ties go to the smaller shard. A node's place hangs on its shard and number alone, so a further shard moves no other's."""
    nodes = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(ring_slots)).cast("int").alias("at")
    )
    return sorted((r["at"], r["shard"]) for r in nodes.collect())


def plan_runs(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Deal the counts of the ring places: (place, lo, hi, shard, base) sends ranks lo <= r < hi to slots base + r - lo.

    Step t offers what is left of each place, in ring order, to the shard of the t-th virtual node clockwise from it.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    done = dict.fromkeys(counts, 0)
    owners, start, k = [s for _, s in nodes], {}, 0
    for p in sorted(counts):
        while k < len(nodes) and nodes[k][0] < p:
            k += 1
        start[p] = k % len(nodes)
    runs, waiting = [], sorted(counts)
    for step in range(len(nodes)):
        for p in waiting:
            s = owners[(start[p] + step) % len(nodes)]
            take = min(counts[p] - done[p], room[s] - used[s])
            if take > 0:
                runs.append((p, done[p], done[p] + take, s, used[s]))
                done[p] += take
                used[s] += take
        waiting = [p for p in waiting if done[p] < counts[p]]
        if not waiting:
            break
    return runs


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of integers from the driver, as one JSON literal that Spark parses: no Python stage is run for it."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.replace(' ', ':') for f in schema.split(', '))}>>")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, vnodes: int = 64, ring_slots: int = 4096, chunk_rows: int = 100_000) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", "crc"), F.lit(ring_slots)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    counts = {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_runs(counts, place_nodes(spark, shards, vnodes, ring_slots), shards)
    parts = _table(spark, [(p, -(-n // chunk_rows)) for p, n in counts.items()], "place int, chunks int")
    rows = rows.join(F.broadcast(parts), "place").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    # where each chunk of a divided place starts; a place of one chunk starts at 0
    sizes = rows.filter("chunks > 1").groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("id", "crc", "row")) - 1)
    if any(n > chunk_rows for n in counts.values()):
        ranked = ranked.join(starts, ["place", "chunk"], "left").withColumn("rank", F.col("rank") + F.coalesce("start", F.lit(0)))
    dealt = _table(spark, runs, RUNS).withColumnRenamed("place", "at")
    out = ranked.join(F.broadcast(dealt), (F.col("place") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
