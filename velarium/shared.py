"""What jobs need from the cluster: code on the executors, lineage cut in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="velarium-"), "velarium.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("velarium", os.path.relpath(full, root)))
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one of our own only where it is unset and the master is local."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "velarium-checkpoints")
    return at


def own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one, for tables, checkpoints and the state of streams; it is deleted when the application ends."""
    at = f"{shared_dir(spark)}/velarium/{spark.sparkContext.applicationId}"
    if at not in _OWN:
        spark.sparkContext.setCheckpointDir(f"{at}/checkpoints")
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table by a reliable checkpoint."""
    own_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed in it leaves no shuffle files once it ends: a job's output is read from its table, and files would stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table below the shared folder as Parquet and read it back."""
    at = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(df.sparkSession):
        df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, name: str, keys: list[str], n: int = 0, **options: str) -> DataFrame:
    """A table below the shared folder dealt to `n` buckets (else as many as partitions of a shuffle) by its keys: a join on them shuffles the other side only."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with passing_shuffles(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).options(**options).option("path", f"{own_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
