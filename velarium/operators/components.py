"""Connected components of a table of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("least").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("least"))
    return (
        down.join(least, "b")
        .select(F.col("least").alias("x"), F.col("a").alias("y"))
        .unionByName(least.select(F.col("least").alias("x"), F.col("b").alias("y")))
        .filter("x <> y")
        .distinct()
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the least node of its component.

    Stars stay small: a round holds at most one row for each node and neighbour that still differ. Each round is
    checkpointed in the shared folder, and the loop ends when a round changes nothing.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    seen = _sum(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = cut(_small_star(_large_star(now)))
        then, seen = seen, _sum(now)
        if then == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
