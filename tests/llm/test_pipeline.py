"""The pipeline as a whole and each stage on its own input."""

from __future__ import annotations

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components, brute_contamination, brute_print, lower


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = stage(spark, docs, SMALL)
        rows = after.collect()
        if name != P.STAGES[-1][0]:
            assert after.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "exact_dedup":
            assert len(rows) == len({lower(t) for _, t in before})
        if name == "near_dedup":
            prints = [brute_print(t) for _, t in before]
            assert len(rows) == len(set(brute_components(prints).values()))
        if name == "decontamination":
            clean = {r[0] for r in brute_contamination(before, items) if not r[-1]}
            assert {r["doc_id"] for r in rows} == clean
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    assert P.run(spark, SMALL).count() == counts[-1]


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names, each stage on its own input."""
    from pyspark.sql import functions as F

    from tests.llm.test_operators import ODD, SCHEMA

    extra = {c: F.lit(0) for c in ("id", "key", "row", "fp", "score", "rank", "a", "b", "n", "h", "root", "hits", "items")}
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns(extra | {"lang": F.lit("en"), "source": F.lit("x"), "quality": F.lit(1)})
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, ODD[0][1]), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda t: lower(t)
    for name, stage in P.STAGES:
        rows = stage(spark, docs, str(tmp_path)).collect()
        if name == "quality":
            assert len(rows) <= len(ODD)
        elif name == "exact_dedup":
            assert sorted(key(r["text"]) for r in rows) == sorted({key(t) for _, t in ODD})
        elif name == "near_dedup":
            assert len(rows) == len(set(brute_components([brute_print(t) for _, t in ODD]).values()))
        elif name == "decontamination":
            assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(i), str(t)) for (i, t) in ODD if not brute_contamination([(i, t)], items)[0][-1])
        else:
            assert len(rows) == len(ODD)
        if name != P.STAGES[-1][0]:
            assert all(set(r.asDict()) == set(docs.columns) for r in rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
