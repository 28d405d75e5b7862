"""Files: .npy vectors, evaluation records of three shapes, logs and reports."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of an evaluation record.
RECORD = (
    "inputs:struct<user_id:string,ground_truth_video_ids:array<string>,total_video_haystack_ids:array<string>,user_demand:string,session_id:string>,"
    "expectations:struct<expected_response:string,expected_facts:array<struct<fact:string,source:string>>,expected_video_ids:array<string>,notes:string>,"
    "metadata:map<string,string>"
)


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, vector) of .npy files; arrays are flattened."""

    @F.arrow_udf("array<float>")
    def decoded(content: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([np.load(io.BytesIO(c.as_py()), allow_pickle=False).astype("float32").ravel().tolist() for c in content], pa.list_(pa.float32()))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", decoded("content").alias("vector"))


def evaluation_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file that holds a list, an object with `records`, or one record."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.records")
    many, one = f"array<struct<{RECORD}>>", F.array(F.from_json("value", f"struct<{RECORD}>"))
    lists = F.when(inner.isNotNull(), F.from_json(inner, many)).when(F.trim("value").startswith("["), F.from_json("value", many)).otherwise(one)
    return whole.select(F.explode(lists).alias("r")).select("r.*").filter(F.col("inputs").isNotNull())


def object_name(frame, timestamp):
    """The name of a frame's object: zero-padded, so that names sort by frame."""
    return F.format_string("%08d_%s", frame, timestamp)


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines without null fields."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
