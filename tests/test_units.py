"""Hand-written cases of the scalar functions and small operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from velarium.functions import text, timecode
from velarium.operators import search, temporal
from velarium.operators.graph import average_linkage


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("a", "b", "wanted"), [((0, 10), (10, 20), False), ((10, 10), (10, 20), True), ((0, 10), (5, 6), True), ((5, 6), (0, 10), True), ((0, 10), (9, 20), True)])
def test_overlap(spark, a, b, wanted):
    assert value(spark, timecode.overlaps(*[F.lit(float(x)) for x in (*a, *b)])) is wanted


@pytest.mark.parametrize(("flags", "wanted"), [([0, 0, 0], [(0, 2)]), ([1, 0, 0, 1, 0], [(1, 3), (4, 4)]), ([1, 1], [(0, 1)])])
def test_shots(spark, flags, wanted):
    rows = spark.createDataFrame([("v", i, f) for i, f in enumerate(flags)], "v string, i int, cut int")
    found = temporal.shots(rows, "v", "i", F.col("cut") == 1).orderBy("shot").collect()
    assert [(r["first"], r["last"]) for r in found] == wanted


@pytest.mark.parametrize(("score", "wanted"), [(0.57, "0.5-0.6"), (-0.05, "0.0-0.1")])
def test_score_bucket(spark, score, wanted):
    assert value(spark, search.bucket_label(F.lit(score))) == wanted


def test_reciprocal_ranks(spark):
    lists = {"a": spark.createDataFrame([(1, 1)], "k int, rank int"), "b": spark.createDataFrame([(2, 1)], "k int, rank int"), "c": spark.createDataFrame([(3, 4)], "k int, rank int")}
    found = {r["k"]: r["rrf_score"] for r in search.reciprocal_ranks(lists, "k").collect()}
    assert found[1] == pytest.approx(1 / 61 + 2 / 161)


def test_resetting_sum(spark):
    rows = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate([10, 25, 5, 40, 3])], "v string, i int, x double")
    found = temporal.resetting_groups(rows, "v", ["i"], "x", 30.0, ["i"]).orderBy("i").collect()
    assert [r["segment"] for r in found] == [0, 0, 1, 1, 2]


def test_even_picks_and_timecodes(spark):
    assert value(spark, timecode.even_picks(F.lit(0), F.lit(60), 5)) == [10, 20, 30, 40, 50]
    assert value(spark, timecode.seconds_to_timecode(F.lit(59.9996))) == "00:01:00.000"
    assert value(spark, timecode.time_to_seconds(F.lit("01:02:03.500"))) == 3723.5
    assert value(spark, timecode.time_to_seconds(F.lit("25:00:00.0"))) is None
    assert value(spark, timecode.parse_time_safe(F.lit("0:00:07"))) == 7.0


def test_neighbours_fall_back_to_the_first(spark):
    rows = spark.createDataFrame([("a", 20, 30)], "key string, start int, end int")
    assert [r["key"] for r in temporal.neighbours(rows, 0, 10, hop=3, include_range=False).collect()] == ["a"]


def test_overlap_join_equals_brute_force(spark):
    a = [("x", float(s), float(s + d)) for s, d in [(0, 5), (3, 40), (17, 0), (60, 2)]]
    b = [("x", float(s), float(s + d)) for s, d in [(5, 5), (17, 1), (40, 30), (2, 1)]]
    schema = "on string, start_sec double, end_sec double"
    found = temporal.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "on", 10.0).collect()
    hit = lambda p, q: min(p[2], q[2]) > max(p[1], q[1]) or (p[1] <= q[1] and q[2] <= p[2]) or (q[1] <= p[1] and p[2] <= q[2])
    assert sorted((r["start_sec"], r["r_start_sec"]) for r in found) == sorted((p[1], q[1]) for p in a for q in b if hit(p, q))


def test_text_functions(spark):
    assert [text.stem(w) for w in ("classes", "running", "cities", "quickly", "see")] == ["class", "run", "citi", "quick", "see"]
    assert value(spark, text.clean_text(F.lit("a re-\n turn\x00  here"))) == "a return here"
    assert value(spark, text.highlight(F.lit("The end"), ["the"])) == "<mark>The</mark> end"
    assert value(spark, text.ngrams(F.lit("ab"))) == []
    assert value(spark, text.unfenced_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, None), (4, "")], "doc_id int, text string")
    found = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["cat", "cat"]).collect()}
    assert set(found) == {1} and found[1] > 0
    assert search.bm25(docs, []).collect() == []


def test_average_linkage():
    import numpy as np

    x = np.array([0.0, 0.1, 5.0])
    labels = average_linkage(np.abs(x[:, None] - x[None, :]), 1.0)
    assert labels[0] == labels[1] != labels[2]


def test_icons_by_the_first_part(spark):
    from velarium.operators.records import icon

    names = {"Image  Recognition": "eye", "Voice Recognition": "microphone", "OCR": "document", "clip search": "photo", "Search": "magnifier", "kg": "chip", None: "chip", "": "chip", "text-recognition": "chip", "Default": "chip"}
    rows = spark.createDataFrame([(k, v) for k, v in names.items()], "name string, wanted string")
    assert rows.filter(icon(F.col("name")) != F.col("wanted")).collect() == []
