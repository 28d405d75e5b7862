"""Queries over whole texts and whole graphs, against brute force."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from velarium.functions import text
from velarium.operators import graph
from velarium.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_whole_texts_are_highlighted_and_counted(spark, texts):
    marked = {r["doc_id"]: r["marked"] for r in QUERIES["highlight_terms_whole"](spark, SMALL).collect()}
    assert marked == {k: t and re.sub("(?i)(and|the)", r"<mark>\1</mark>", t) for k, t in texts.items()}
    grams = {r["doc_id"]: r["grams"] for r in QUERIES["trigram_counts_whole"](spark, SMALL).collect()}
    lower = {k: (t or "").lower() for k, t in texts.items()}
    assert grams == {k: len({t[i : i + 3] for i in range(len(t) - 2)}) for k, t in lower.items()}


def test_all_documents_are_cleaned(spark, texts):
    assert {r["doc_id"] for r in QUERIES["ocr_clean_whole"](spark, SMALL).collect()} == set(texts)
    row = spark.range(1).select(text.clean_text(F.lit("größ-\n ere Stra\u00dfen-\nbahn\x00  é")).alias("v")).first()
    assert row["v"] == "größere Straßenbahn é"


def test_walks_start_at_every_node(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    edges = {(r[0], -1 - r[1]) for r in lines}
    either = edges | {(b, a) for a, b in edges}
    paths = [r["path"] for r in QUERIES["random_walks"](spark, SMALL).collect()]
    assert {p[0] for p in paths} == {a for a, _ in either} and len(paths) == 10 * len({a for a, _ in either})
    assert all(len(p) == 80 and all(step in either for step in zip(p, p[1:], strict=False)) for p in paths)


def test_walks_by_weight_and_by_number_agree(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (4, 5, 1.0)], "src int, dst int, weight double")
    found = [sorted(map(tuple, graph.walks(edges, 4, 6, weighted=w).collect()), key=str) for w in (False, True)]
    assert found[0] == found[1]
