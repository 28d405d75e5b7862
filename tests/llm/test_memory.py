"""What a task holds at once, however large its part of the input is."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from velarium.llm import collocations, decontaminate


def test_index_rows_lie_in_small_groups(spark):
    text = F.expr("concat_ws(' ', transform(sequence(1, 400000), x -> hex(id * 400000 + x + 1000000)))")
    docs = spark.range(16, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.col("id").alias("key"), text.alias("text"))
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in decontaminate.build_index(docs).inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 8  # two texts each
    # a reader decodes a group at once; before, a hundred rows of megabytes were written before the writer looked at their size
    assert max(g.total_byte_size for g in groups) < 32 << 20


def test_a_block_of_items_is_flat():
    items = [(str(k % 7), " ".join(str(k * 100 + j) for j in range(100))) for k in range(200)] + [(None, "0 1 2"), ("x", "0 1 2"), ("y", "0 1 2")]
    side = decontaminate.TestSide(items)
    windows = {side.window(k): side.names(k) for k in range(len(side.table))}
    assert len(windows) == 200 * 91 + 1
    code = {w: n for n, w in enumerate(side.terms.to_pylist())}
    assert windows[tuple(code[w] for w in ("0", "1", "2"))] == ["x", "y"]
    assert windows[tuple(code[str(1500 + j)] for j in range(3, 13))] == ["1"]
    # some 40 bytes a window and 8 a name; tuples and lists of each window were five times that when pickled and more in a task
    assert len(pickle.dumps(side)) < 70 * len(windows) + 16 * len(side.terms)


def test_sketches_of_much_text_let_little_through(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(" ".join(f"word{n:012d}" for n in rng.integers(0, 20_000, 200)), "en") for _ in range(200)] + [("new york city hall", "en")] * 40
    own, seen = collocations.sketch, []
    monkeypatch.setattr(collocations, "sketch", lambda *a, **k: seen.append(own(*a, **k)) or seen[-1])
    found = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string").repartition(3), cells=(64, 1024)).filter("words = 4").collect()
    assert [(r["phrase"], r["f"]) for r in found] == [("new york city hall", 40)]
    # before, one sketch of 1,024 cells for 160,000 phrases: every cell was reached, and all phrases went on to the exact pass
    assert max(np.unpackbits(bits).mean() for bits in seen) < 0.2


def test_hashes_of_strings_differ():
    words = pa.array(["", "a", "b", "ab", "ba", "é", "a" * 5000, "\x00", "\x00\x00", *(f"w{n}" for n in range(100_000))])
    assert len(np.unique(collocations._hash(words))) == len(words)
    assert (collocations._hash(words.slice(1, 4)) == collocations._hash(words)[1:5]).all()
