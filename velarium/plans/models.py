"""Slots for model calls. The stand-ins are deterministic, so that searches can be run and tested without a model server."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

Encoder = Callable[[Column], Column]


def hashed_encoder(size: int = 64) -> Encoder:
    """Term hashing to a unit vector: a term counts 1 or -1, by a hash bit, in the component of its hash mod size. Terms are hashed in the JVM; a batch of texts is summed at once."""
    from velarium.functions.text import terms

    @F.arrow_udf("array<double>")
    def summed(hashes: pa.Array) -> pa.Array:
        hashes = pc.fill_null(hashes, pa.scalar([], hashes.type))
        counts = pc.list_value_length(hashes).to_numpy(zero_copy_only=False)
        flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.zeros((len(hashes), size))
        np.add.at(sums, (np.repeat(np.arange(len(hashes)), counts), flat % size), np.where((flat >> 32) & 1, -1.0, 1.0))
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        sums /= np.where(length > 0, length, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(hashes) + 1, size, dtype=np.int32)), pa.array(sums.ravel()))

    return lambda text: summed(F.transform(terms(text), lambda t: F.xxhash64(t)))


def with_vectors(rows: DataFrame, text: str, encoder: Encoder, vector: str = "embedding") -> DataFrame:
    """Rows with text that is not blank, and its vector."""
    return rows.filter(F.trim(text) != "").withColumn(vector, encoder(F.col(text)))


def fan_out(queries: list[str], search: Callable[[str], DataFrame], key: str) -> DataFrame:
    """Run a search for each variant of a question; a key keeps its best score."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [search(q).select(key, "score") for q in dict.fromkeys(queries)])
    return every.groupBy(key).agg(F.max("score").alias("score"))


def in_batches(rows: DataFrame, column: str, call: Callable[[list], list], kind: str, out: str, size: int = 32, tries: int = 2) -> DataFrame:
    """Rows with a model's answer, `size` values a call; a call that fails `tries` times gives nulls for its values and the others go on. A task all of whose calls fail is an error, so a broken model shows."""

    answer = to_arrow_type(_parse_datatype_string(kind))

    def run(values: pa.Array) -> pa.Array:
        found, failed, last = [], 0, None
        for k in range(0, len(values), size):
            part = values.slice(k, size).to_pylist()
            for attempt in range(tries):
                try:
                    found += call(part)
                    break
                except Exception as e:  # noqa: BLE001
                    if attempt == tries - 1:
                        found, failed, last = found + [None] * len(part), failed + 1, e
        if failed > 1 and failed == -(-len(values) // size):
            raise RuntimeError(f"all {failed} calls of a batch failed") from last
        return pa.array(found, answer)

    return rows.withColumn(out, F.arrow_udf(run, kind)(F.col(column)))
