"""Links between events without a join of all pairs, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from velarium.operators import graph as G


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        base = [1.0 if j == k % 5 else 0.0 for j in range(6)]
        members = None if k == 7 else [] if k == 8 else [int(30 * rng.random() ** 2) for _ in range(rng.randrange(1, 9))]
        vector = None if k == 9 else [0.0] * 6 if k == 10 else [x + rng.gauss(0, 0.4) for x in base]
        rows.append((k % 4, rng.randrange(40), k, vector, members))
    return spark.createDataFrame(rows, "grp int, idx int, o long, v array<double>, m array<int>")


def rows(frame):
    return sorted((r["grp"], r["a"], r["b"], r["similarity"], r["shared"], r["jaccard"], r["edge_type"]) for r in frame.collect())


@pytest.mark.parametrize(("strong", "overlap", "following"), [(0.75, 0.3, True), (0.9, 0.5, False), (2.0, 0.05, False), (0.2, 1.0, True)])
def test_links_equal_all_pairs(events, strong, overlap, following):
    every = G.linked(G.event_pairs(events, "grp", "idx", "o", "v", "m"), strong, overlap, following)
    assert rows(G.event_links(events, "grp", "idx", "o", "v", "m", strong, overlap, following)) == rows(every) != []


def test_candidates_are_few(spark):
    rng = random.Random(5)
    sets = spark.createDataFrame([(0, k, [rng.randrange(300) for _ in range(8)]) for k in range(600)], "g int, k int, m array<int>")
    n = G.overlapping_pairs(sets, "g", "k", "m", 0.5).count()
    assert n < 0.1 * 600 * 599 / 2
    every = sets.alias("x").join(sets.alias("y"), F.expr("x.k < y.k")).filter(F.expr("size(array_intersect(x.m, y.m)) >= 0.5 * size(array_union(x.m, y.m))"))
    assert every.count() <= n


@pytest.mark.parametrize(("strong", "overlap", "following"), [(0.75, 0.3, True), (0.9, 0.5, False), (2.0, 0.05, False), (0.2, 1.0, True)])
def test_tied_links_equal_pairs_in_the_window(events, monkeypatch, strong, overlap, following):
    monkeypatch.setattr(G, "WIDE", 2)
    every = G.linked(G.event_pairs(events, "grp", "idx", "o", "v", "m").filter("pb - pa <= 3"), strong, overlap, following)
    assert rows(G.linked(G.event_pairs(events, "grp", "idx", "o", "v", "m", window=3), strong, overlap, following)) == rows(every) != []
    assert rows(G.tied_links(events, "grp", "idx", "o", "v", "m", 3, strong, overlap, following)) == rows(every)


def test_links_of_long_groups_equal_all_pairs(events, monkeypatch):
    every = rows(G.linked(G.event_pairs(events, "grp", "idx", "o", "v", "m"), 0.75, 0.3))
    monkeypatch.setattr(G, "WIDE", 17)  # four blocks a group, and products of blocks
    assert rows(G.event_links(events, "grp", "idx", "o", "v", "m", 0.75, 0.3)) == every != []


def test_events_of_short_groups_are_shuffled_once(spark, events):
    small = events.withColumn("grp", F.expr("IF(o % 60 = 1, NULL, o % 60)"))
    assert rows(G.event_links(small, "grp", "idx", "o", "v", "m", 0.75, 0.3)) == rows(G.linked(G.event_pairs(small, "grp", "idx", "o", "v", "m"), 0.75, 0.3)) != []

    def written(frame):
        sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
        before = sent()
        frame().write.format("noop").mode("overwrite").save()
        return sent() - before

    rng = random.Random(6)
    wide = spark.createDataFrame([(k % 400, k, k, [rng.gauss(0, 1) for _ in range(64)], [k % 7]) for k in range(4000)], "grp int, idx int, o long, v array<double>, m array<int>")
    once = written(lambda: wide.repartition(8, "grp"))
    # before, vectors were shuffled for the search and twice for the pairs it found
    assert written(lambda: G.event_links(wide, "grp", "idx", "o", "v", "m", 0.0, 0.3)) < 1.5 * once


def test_tied_events_are_sent_to_stretches_of_positions(spark):
    rng = random.Random(7)
    wide = spark.createDataFrame([(k % 3, k // 1200, k, [rng.gauss(0, 1) for _ in range(64)], [k % 7]) for k in range(12_000)], "grp int, idx int, o long, v array<double>, m array<int>")

    def written(frame):
        sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
        before = sent()
        frame().write.format("noop").mode("overwrite").save()
        return sent() - before

    once, key = written(lambda: wide.repartition(8, "grp")), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    ratio = written(lambda: G.tied_links(wide, "grp", "idx", "o", "v", "m", 5, 0.3, 1.0, following=False)) / once
    spark.conf.set(key, before)
    # before, by group, once for each distance and once as the other side: seven times
    assert ratio < 4
