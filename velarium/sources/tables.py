"""Table scans with the columns and predicates the data model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_json(rows: DataFrame, column: str, path: str, value, root_key: str | None = None) -> DataFrame:
    """Rows whose JSON field equals a value, and the row with that key itself if `root_key` is given."""
    hit: Column = F.get_json_object(column, path) == F.lit(str(value))
    return rows.filter(hit | (F.col(root_key) == value) if root_key else hit)


def thumbnails(at: float, fps: float, last: int) -> list[int]:
    """Frames at -5, -2.5, 0, 2.5 and 5 s around a time, held inside [0, last]."""
    return [min(max(int((at + d) * fps), 0), last) for d in (-5.0, -2.5, 0.0, 2.5, 5.0)]
