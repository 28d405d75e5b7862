"""Files, timecodes and small timed operators that no query covers."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.functions import keys, text, timecode
from velarium.operators import chat, temporal
from velarium.plans import models
from velarium.sources import files, tables
from velarium.streaming import sessions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_npy_vectors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float64).reshape(2, 3))
    np.save(tmp_path / "b.npy", np.zeros(0))
    (tmp_path / "c.txt").write_text("no vector")
    found = {r["path"].rsplit("/", 1)[-1]: r["vector"] for r in files.npy_vectors(spark, str(tmp_path)).collect()}
    assert found == {"a.npy": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], "b.npy": []}


RECORD = {"inputs": {"user_id": "u", "ground_truth_video_ids": ["v"], "user_demand": "d"}, "expectations": {"expected_response": "r"}}


@pytest.mark.parametrize(("shape", "n"), [([RECORD, RECORD], 2), ({"records": [RECORD]}, 1), (RECORD, 1)])
def test_evaluation_records(spark, tmp_path, shape, n):
    (tmp_path / "x.json").write_text(json.dumps(shape))
    found = files.evaluation_records(spark, str(tmp_path / "x.json")).collect()
    assert len(found) == n and all(r["inputs"]["ground_truth_video_ids"] == ["v"] and r["expectations"]["expected_response"] == "r" for r in found)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    files.write_report(rows, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["n", "s"]
    files.write_report(rows, str(tmp_path / "j"), "json")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"n":1,"s":"a"}', '{"n":2}']
    assert value(spark, files.object_name(F.lit(42), F.lit("t"))) == "00000042_t"


def test_thumbnails():
    assert tables.thumbnails(3.0, 10.0, 60) == [0, 5, 30, 55, 60]


def test_timecode_functions(spark):
    assert value(spark, timecode.gap_text(F.lit(3661.26))) == "01:01:01.3"
    assert value(spark, timecode.truncated_duration(F.lit(1.9999))) == "00:00:01.999"
    assert value(spark, timecode.frames_to_timestamp(F.lit(50), F.lit(25.0))) == "00:00:02.000"
    assert [value(spark, timecode.timecode_to_frame(F.lit(t), F.lit(1.0))) for t in ("00:00:00.500", "00:00:01.500", "bad")] == [0, 2, None]
    assert [value(spark, timecode.fps_of(F.lit(r))) for r in ("30000/1001", "25", "1/0")] == [pytest.approx(29.97002997), 25.0, None]
    assert value(spark, timecode.offsets_around(F.lit(3.0), [-5.0, 0.0, 5.0], F.lit(10.0), F.lit(60))) == [0, 30, 60]
    assert value(spark, timecode.time_to_frame(F.lit(1.99), F.lit(10.0))) == 19


def test_around(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (8.0, 12.0), (30.0, 40.0)], "start_sec double, end_sec double")
    assert [r["start_sec"] for r in temporal.around(rows, 10.0, 20.0, 5.0).collect()] == [8.0]
    assert [r["start_sec"] for r in temporal.around(rows, 10.0, 20.0, 12.0, 60.0).collect()] == [0.0, 8.0, 30.0]
    for start, end in ((-1.0, 5.0), (5.0, 5.0), (5.0, 70.0)):
        with pytest.raises(ValueError):
            temporal.around(rows, start, end, 1.0, 60.0)


def test_neighbour_images(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in (1, 5, 9, 12)], "key string, frame_index int")
    keys_of = lambda df: [r["key"] for r in df.orderBy("rank").collect()]
    assert keys_of(temporal.neighbour_images(rows, 5, 2)) == ["k5", "k9"]
    assert keys_of(temporal.neighbour_images(rows, 9, 3, forward=False)) == ["k9", "k5", "k1"]
    assert keys_of(temporal.neighbour_images(rows, 5, 3, include_range=False)) == ["k12"]
    assert keys_of(temporal.neighbour_images(rows, 12, 3, include_range=False)) == ["k12"]


@pytest.mark.parametrize("n", [1, 49, 50, 51, 120, 200])
def test_padded_batches_keep_each_frame_once(n):
    kept = [f for a, _ in temporal.hop_batches(n) for f in range(a + 25, a + 75) if f < n]
    assert kept == list(range(n)) and all(b - a == 100 for a, b in temporal.hop_batches(n))


def test_merged_segments(spark):
    rows = spark.createDataFrame([("v", i, float(i), float(i + 1), f"t{i}", 20.0) for i in range(5)], "v string, i int, a double, b double, t string, d double")
    grouped = temporal.resetting_groups(rows, "v", ["i"], "d", 40.0, ["i", "a", "b", "t"])
    found = temporal.merged_segments(grouped, "v", "a", "b", "t", "i").orderBy("segment").collect()
    assert [(r["segment"], r["n"], r["start"], r["end"], r["text"]) for r in found] == [(0, 2, 0.0, 2.0, "t0 t1"), (1, 2, 2.0, 4.0, "t2 t3"), (2, 1, 4.0, 5.0, "t4")]


def test_resetting_groups_of_many_timelines(spark):
    rows = spark.createDataFrame([(k % 7, k, float(k % 5)) for k in range(3000)], "v int, i int, d double").repartition(6)
    found = {r["i"]: r["segment"] for r in temporal.resetting_groups(rows, "v", ["i"], "d", 9.0, ["i"]).collect()}
    for v in range(7):
        total, segment = 0.0, 0
        for k in range(v, 3000, 7):
            assert found[k] == segment
            total += k % 5
            if total >= 9.0:
                total, segment = 0.0, segment + 1


def test_kept_kinds_and_blocks(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "event_type string")
    assert [r["event_type"] for r in sessions.kept_kinds(rows, ["b", "c"]).collect()] == ["b"]
    blocks = spark.createDataFrame([(1, [("x",), ("say Hello there",)]), (2, [("none",)])], "id int, blocks array<struct<text:string>>")
    assert [(r["id"], r["snippet"]) for r in chat.block_search(blocks, "hello", around=2).collect()] == [(1, "...y Hello t...")]


def test_text_slots(spark):
    assert value(spark, text.numbered_lines(F.lit("a\n\n # no\n b "))) == ["a", "b"]
    titled = value(spark, text.titled(F.lit("**T x** body\nmore")))
    assert (titled["title"], titled["body"]) == ("T x", "body\nmore")
    plain = value(spark, text.titled(F.lit("no title")))
    assert (plain["title"], plain["body"]) == ("Thinking", "no title")
    assert value(spark, text.transcript(F.lit("language en <asr_text> hello "))) == "hello"
    assert value(spark, text.without_image_marks(F.lit("a ![x](y) b <image>"))) == "a  b "
    assert value(spark, text.truncated(F.lit("abcdef"), 3)) == "abc..." and value(spark, text.truncated(F.lit("abc"), 3)) == "abc"
    assert value(spark, text.fragments(F.lit("x" * 250 + "The end"), ["the"], 200, 3)) == ["x" * 50 + "<mark>The</mark> end"]
    assert value(spark, keys.strip_collection(F.lit("a/b/c"))) == "b/c"
    with pytest.raises(Exception, match="no collection"):
        value(spark, keys.strip_collection(F.lit("abc")))
    parts = value(spark, keys.url_parts(F.lit("http://h/b/o/p")))
    assert (parts["bucket"], parts["object"]) == ("b", "o/p")


def test_required_values_keep_their_type(spark):
    from velarium.operators.scope import list_argument, required

    assert value(spark, required(F.lit(3), "x")) == 3 and value(spark, required(F.lit("a"), "x")) == "a"
    with pytest.raises(Exception, match="missing x"):
        value(spark, required(F.lit(None).cast("int"), "x"))
    assert list_argument('["a"]') == ["a"] and list_argument("no") is None and list_argument({}) is None


def test_fan_out_keeps_the_best_score(spark):
    rows = {"a": [(1, 0.5), (2, 0.1)], "b": [(1, 0.7)]}
    found = models.fan_out(["a", "b", "a"], lambda q: spark.createDataFrame(rows[q], "k int, score double"), "k")
    assert {r["k"]: r["score"] for r in found.collect()} == {1: 0.7, 2: 0.1}


def test_a_model_that_always_fails_is_an_error(spark):
    def broken(part):
        raise ValueError("down")

    with pytest.raises(Exception, match="calls of a batch failed"):
        models.in_batches(spark.range(10).coalesce(1), "id", broken, "long", "y", size=4).collect()
