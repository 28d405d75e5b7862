"""Results of tools as a catalog table that sessions and applications share.

A folder holds `catalog` (handle, snapshot, folder, made) and a Parquet folder a result. A handle hangs on the tool and all its arguments, a snapshot on the files that the result was read from (their
paths, lengths and times of change), so an input that changed, or an entry older than `seconds`, is a miss. A row of the catalog is written after its result, so a result that failed midway isn't found; of
several the last counts. Entries that are over go by `sweep`.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.plans.registry import handle

CATALOG = "handle string, snapshot string, folder string, made double"


def snapshot(source: DataFrame) -> str:
    """A digest of the files that a table is read from; only their names, lengths and times are read. A table without files has the digest of none."""
    files = source.inputFiles()
    if not files:
        return "none"
    listed = source.sparkSession.read.format("binaryFile").load([f for f in files]).select(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")).alias("f"))
    # sums of two hashes, so that no list of files is gathered in one place
    r = listed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), "f").cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]).first()
    return f"{r['n']}:{r['h0']}:{r['h1']}"


class StoredResults:
    def __init__(self, spark: SparkSession, folder: str, seconds: float = 86_400.0, now: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.seconds, self.now = spark, folder, seconds, now

    def _catalog(self) -> DataFrame:
        empty = self.spark.createDataFrame([], CATALOG)
        try:
            return empty.unionByName(self.spark.read.schema(CATALOG).parquet(f"{self.folder}/catalog"))
        except Exception as e:  # no result was ever kept here
            if "PATH_NOT_FOUND" in str(e):
                return empty
            raise

    def find(self, tool: str, args: dict, sources: list[DataFrame]) -> DataFrame | None:
        """The result that is kept for these arguments over these inputs as they are now, or none."""
        mark = "/".join(snapshot(s) for s in sources)
        own = self._catalog().filter((F.col("handle") == handle(tool, args)) & (F.col("snapshot") == mark) & (F.col("made") >= self.now() - self.seconds))
        row = own.orderBy(F.col("made").desc(), "folder").limit(1).collect()
        return self.spark.read.parquet(f"{self.folder}/results/{row[0]['folder']}") if row else None

    def get(self, tool: str, args: dict, sources: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result, or `make`'s, which is then kept."""
        found = self.find(tool, args, sources)
        if found is not None:
            return found
        mark, at = "/".join(snapshot(s) for s in sources), uuid.uuid4().hex
        made = make()
        made.write.parquet(f"{self.folder}/results/{at}")
        self.spark.createDataFrame([(handle(tool, args), mark, at, float(self.now()))], CATALOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/catalog")
        return self.spark.read.schema(made.schema).parquet(f"{self.folder}/results/{at}")

    def sweep(self) -> DataFrame:
        """Entries that are over, as (handle, folder): what may be deleted."""
        return self._catalog().filter(F.col("made") < self.now() - self.seconds).select("handle", "folder")
