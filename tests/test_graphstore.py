"""Stored graphs: whole loads, checked ends, deletion on both sides, sweeping; ordinal joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from velarium.operators import graphstore as GS
from velarium.operators import records as R


def rows(spark, entities=(1, 2), events=(7,), edges=((7, 1), (7, 2)), video="v1"):
    vertex = lambda keys: spark.createDataFrame([(str(k), video) for k in keys], "key string, video_id string")
    return {"entities": vertex(entities), "events": vertex(events), "event_entities": spark.createDataFrame([(str(a), str(b), "HAS") for a, b in edges], "src string, dst string, edge_type string")}


def held(store):
    return {n: sorted(tuple(r) for r in df.drop("key").collect()) if "src" in df.columns else sorted(tuple(r) for r in df.collect()) for n, df in store.read().items()}


def test_loading_twice_changes_nothing(spark, tmp_path):
    store = GS.GraphStore(spark, str(tmp_path))
    assert store.version() == 0 and store.read() == {}
    store.load(rows(spark))
    first = held(store)
    assert store.load(rows(spark)) == 2
    assert held(store) == first and len(first["event_entities"]) == 2


def test_a_wrong_edge_is_reported_and_nothing_changes(spark, tmp_path):
    store = GS.GraphStore(spark, str(tmp_path))
    store.load(rows(spark))
    first = held(store)
    with pytest.raises(GS.WrongEdges, match="no dst 9"):
        store.load(rows(spark, entities=(3,), edges=((7, 9),)))
    assert store.version() == 1 and held(store) == first
    with pytest.raises(GS.WrongEdges, match="no src 7"):
        GS.GraphStore(spark, str(tmp_path / "other")).load({n: r for n, r in rows(spark).items() if n != "events"})


def test_a_load_that_fails_midway_changes_nothing(spark, tmp_path):
    store = GS.GraphStore(spark, str(tmp_path))
    store.load(rows(spark))
    first = held(store)
    bad = rows(spark, entities=(5,), events=(8,), edges=((8, 5),))
    bad["events"] = bad["events"].withColumn("key", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.load(bad)
    assert held(store) == first
    with pytest.raises(Exception, match="missing key"):
        store.load({"entities": spark.createDataFrame([(None, "v1")], "key string, video_id string")})
    assert held(store) == first
    assert store.sweep() > 0 and held(store) == first


def test_videos_go_with_edges_of_both_sides(spark, tmp_path):
    store = GS.GraphStore(spark, str(tmp_path))
    store.load(rows(spark))
    store.load(rows(spark, entities=(3,), events=(8,), edges=((8, 3), (8, 1), (7, 3)), video="v2"))
    lost = {r["collection"]: r["deleted"] for r in store.delete_videos(spark.createDataFrame([("v2",), ("v2",), (None,), ("none",)], "video_id string")).collect()}
    assert lost == {"entities": 1, "events": 1, "event_entities": 3}
    assert held(store) == {"entities": [("1", "v1"), ("2", "v1")], "events": [("7", "v1")], "event_entities": [("7", "1", "HAS"), ("7", "2", "HAS")]}
    old = store.read(2)
    assert old["event_entities"].count() == 5
    store.sweep(1)
    assert store.version() == 3 and store.read()["event_entities"].count() == 2


def test_ordinal_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 1), (None, 1)], "g string, n long")
    right = spark.createDataFrame([("a", 4, [1.0]), ("a", 3, [2.0]), ("b", 1, None), ("c", 1, [9.0]), (None, 1, [8.0])], "g string, n long, v array<double>")
    found = {(r["g"], r["n"]): r["v"] for r in R.ordinal_join(left, right, "v", ["g"], ["n"]).collect()}
    assert found == {("a", 1): [2.0], ("a", 2): [1.0], ("a", 5): [], ("b", 1): [], (None, 1): []}
    assert R.ordinal_join(left.limit(0), right, "v", ["g"], ["n"]).count() == 0
    assert R.ordinal_join(left, right.limit(0), "v", ["g"], ["n"]).filter(F.size("v") == 0).count() == 5
