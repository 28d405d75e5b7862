"""Steps that have to grow no faster than their input, and rules that hold beyond the smallest tables."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.comparing import same
from velarium.functions import text
from velarium.operators import graph as G
from velarium.operators import graphstore as GS
from velarium.operators import kgbuild as K
from velarium.operators import retrieval as R
from velarium.operators import store
from velarium.queries import ORACLE_SQL, QUERIES
from velarium.queries.search import _bm25_sql
from velarium.shared import bucketed, stored


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString().lower()


def test_votes_of_a_long_group_look_ahead_by_a_growing_window(spark):
    rng = random.Random(3)
    rows = [(0, k, rng.randrange(60), rng.randrange(200)) for k in range(300)]
    events = spark.createDataFrame(rows, "g int, o long, at int, member int")
    members = spark.createDataFrame([(m, m % 4) for m in range(40)], "member int, community int")
    found = G.community_votes(events, members, "g", "o", F.col("at"))
    # a frame that ends at the group's end is counted anew at every row
    assert "unboundedfollowing" not in plan(found)
    order = sorted((at, o, m % 4 if m < 40 else None) for _, o, at, m in rows)
    wanted = {}
    for k, (at, o, own) in enumerate(order):
        before = next(((t, c) for t, _, c in reversed(order[:k]) if c is not None), None)
        after = next(((t, c) for t, _, c in order[k + 1 :] if c is not None), None)
        near = before if after is None or (before and at - before[0] <= after[0] - at) else after
        wanted[o] = own if own is not None else near[1]
    assert {r["o"]: r["community"] for r in found.collect()} == wanted


def test_numbered_keys_keep_all_digits_in_both(spark, tmp_path):
    spark.createDataFrame([(n,) for n in (0, 7, 9999, 10000, 1234567)], "event_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same(QUERIES["document_keys"](spark, str(tmp_path)), con.sql(ORACLE_SQL["document_keys"]))


def test_bm25_in_sql_adds_up_in_the_order_of_terms():
    rng = random.Random(6)
    rows = [{w: rng.randrange(1, 9) for w in rng.sample(("and", "der", "the", "with"), 4)} for _ in range(3000)]
    con = duckdb.connect()
    texts = [" ".join(w for w, n in r.items() for _ in range(n)) for r in rows]
    con.execute("CREATE TABLE documents AS SELECT unnest(range(3000)) AS doc_id, unnest(?) AS text", [texts])
    found = dict(con.sql(_bm25_sql(["and", "der", "the", "with"])).fetchall())
    mean = sum(sum(r.values()) for r in rows) / len(rows)
    idf = math.log(1.0 + 0.5 / (len(rows) + 0.5))
    for k, r in enumerate(rows):
        score = 0.0
        for w in sorted(r):
            score += idf * r[w] * 2.2 / (r[w] + 1.2 * (0.25 + 0.75 * sum(r.values()) / mean))
        assert found[k] == score


@pytest.mark.parametrize("sparse", [None, "s"])
def test_a_large_component_clusters_by_rounds_as_by_its_matrix(spark, sparse):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(2):
        base, drift = rng.normal(size=6), rng.normal(size=(4, 6)) * 0.6
        for k in range(120):
            v = base + drift[k % 4] + rng.normal(size=6) * 0.5
            rows.append((g, 200 * g + k, [float(x) for x in v], [(int(k % 3), 2.0)]))
        # forty copies of the first point
        rows += [(g, 200 * g + 150 + k, rows[-120][2], [(0, 2.0)]) for k in range(40)] if g == 0 else []
    frame = spark.createDataFrame(rows, "g int, key int, v array<double>, s array<struct<term:int,weight:double>>")
    cut_at = 0.7
    found = {most: {r["key"]: r["cluster"] for r in G.resolved_entities(frame, "g", "key", "v", cut_at, sparse, most=most, block=16).collect()} for most in (10, 1000)}
    assert found[10] == found[1000]
    for g in range(2):
        own = [r for r in rows if r[0] == g]
        x = np.array([r[2] for r in own]) / np.linalg.norm([r[2] for r in own], axis=1, keepdims=True)
        s = x @ x.T
        if sparse:
            s = 0.9 * s + 0.1 * np.array([[float(a[3] == b[3]) for b in own] for a in own])
        labels = G.average_linkage(np.clip(1 - s, 0, 2), 1 - cut_at)
        assert 1 < len(set(labels)) < 60
        assert {frozenset(r[1] for r in own if found[10][r[1]] == c) for c in {found[10][r[1]] for r in own}} == {frozenset(own[i][1] for i in np.flatnonzero(labels == c)) for c in set(labels)}


def test_a_bucketed_table_stays_where_it_is(spark):
    table = bucketed(spark.range(500).selectExpr("id % 50 AS a", "id % 7 AS b", "id AS c"), "stays", ["a", "b"])
    asked = spark.range(40).selectExpr("id AS a", "id % 7 AS b")
    found = asked.hint("shuffle_hash").join(table, ["a", "b"])
    assert found.count() == sum(1 for n in range(500) for k in range(40) if (n % 50, n % 7) == (k, k % 7))
    assert plan(found).rsplit("== physical plan ==", 1)[1].count("exchange hashpartitioning") == 1


def test_long_walks_are_put_together_in_order(spark):
    ring = spark.createDataFrame([(n, (n + 1) % 12) for n in range(12)], "src long, dst long")
    found = G.walks(ring, 1, 23).collect()
    assert sorted(r["path"][0] for r in found) == list(range(12))
    assert all(len(r["path"]) == 23 and all((b - a) % 12 in (1, 11) for a, b in zip(r["path"], r["path"][1:], strict=False)) for r in found)


def test_texts_of_a_cluster_meet_its_members_last(spark):
    rows = spark.createDataFrame([("c", k, f"n{k}", "" if k == 1 else f"d{k}") for k in range(4)], "cluster string, local_id int, name string, desc string")
    out = K.resolution(rows)
    assert {r["merged_desc"] for r in out.collect()} == {"d0 d2 d3"} and {r["canonical_name"] for r in out.collect()} == {"n3"}
    logical = plan(out).split("== optimized logical plan ==")[1].split("== physical plan ==")[0]
    # the sizes on both sides, then all that a part says at once
    assert len([line for line in logical.splitlines() if "join " in line]) == 3


def test_stages_become_one_row_a_pair_before_any_node_is_asked(spark):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "node string")
    e = lambda *rows: spark.createDataFrame(rows, "src string, dst string, weight double")
    out = K.laid_over(nodes, [(e(("a", "b", 1.0), ("b", "a", None), ("b", "c", 2.0)), "sum"), (e(("b", "c", None), ("z", "a", 1.0)), "set"), (e(("a", "b", 0.5), ("c", "b", 3.0)), "max"), (e(("a", "b", 7.0), ("a", "c", 7.0)), "absent")])
    assert {(r["a"], r["b"]): r["weight"] for r in out.collect()} == {("a", "b"): 1.0, ("b", "c"): 3.0, ("a", "c"): 7.0}
    # lists of a pair's stages would be sorted into groups, and edges by stage shuffled to the nodes
    physical = plan(out).rsplit("== physical plan ==", 1)[1]
    assert "collect_list" not in physical and "objecthashaggregate" not in physical


def test_ngrams_are_found_in_one_pass(spark):
    texts = ["ab", "", None, "a\nb\r c", "x\U0001f600\U0001f601yz", "aaaa"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.ngrams(F.col("t"), 3).alias("g"))
    assert {r["t"]: r["g"] for r in frame.collect()} == {t: [t[i : i + 3] for i in range(len(t or "") - 2)] for t in texts}
    # a function of an array would be run anew for each character, not compiled
    assert "lambda" not in plan(frame)


def test_shots_of_one_video_are_numbered_by_ranges(spark):
    rows = [(k, "v", (k * 37) % 101, (k * 37) % 101 + k % 3) for k in range(400)]
    session = R.Session({"shots": R.Collection(spark.createDataFrame(rows, "key long, video_id string, start_frame long, end_frame long"), ())}, lambda _: None)
    found = R.get_video_timeline(session, "v", "shot")
    assert [(r["shot_number"], r["start_frame"], r["end_frame"]) for r in found.collect()] == [(n + 1, *x) for n, x in enumerate(sorted((r[2], r[3]) for r in rows))]
    assert "windowspecdefinition(video_id" not in plan(found)


def test_a_round_of_labels_shuffles_the_neighbourhoods_of_its_half_once(spark):
    rng = random.Random(5)
    rows = [(a, b, 1.0) for a in range(600) for b in rng.sample(range(600), 60) if a < b]
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
    moved = []
    for rounds in (1, 5):
        began = written()
        assert G.communities(edges, rounds).count() == 600
        moved.append(written() - began)
    assert (moved[1] - moved[0]) / 4 / len(rows) < 12


def test_rows_are_dealt_by_key_before_their_text_is_made(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "w"), ("b", 1, None)], "k string, n int, v string")
    out = store.one_of_each(rows, ["k"])
    below = plan(out).rsplit("== physical plan ==", 1)[1].split("exchange", 1)[1]
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2, "w"), ("b", 1, None)]
    assert "to_json" not in below and "structstojson" not in below


def test_ends_are_looked_for_before_edges_are(spark):
    state = {"events": spark.createDataFrame([("1",)], "key string"), "entities": spark.createDataFrame([("5",)], "key string")}
    of = lambda *e: {**state, "event_entities": spark.createDataFrame(e, "key string, src string, dst string")}
    assert not GS.unknown_ends(of(("k", "1", "5"), ("l", "1", "5")))
    for wrong in (("k", "1", "6"), ("k", "2", "5"), ("k", "1", None)):
        assert GS.unknown_ends(of(("l", "1", "5"), wrong)) and GS.wrong_edges(of(("l", "1", "5"), wrong)).count() == 1


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(k).getName() for k in range(blocks.size())}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = files(), spark.conf.get(key)
    table = stored(spark.range(1000).repartition(5, "id"), "left")
    dealt = bucketed(table, "left", ["id"])
    # before, they stayed until the driver collected garbage, so walks of 80 steps left the files of 80 shuffles
    assert not [f for f in files() - before if f.startswith("shuffle_") and f.endswith(".data")]
    assert spark.conf.get(key) == set_to and dealt.count() == 1000


def test_pairs_of_stages_are_dealt_once_for_their_greater_end(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    e = lambda *rows: spark.createDataFrame(rows, "src string, dst string, weight double")
    out = K.laid_over(nodes, [(e(("d", "a", 1.0), ("a", "d", 2.0), ("a", "z", 2.0), (None, "a", 1.0)), "sum"), (e(("a", "d", 2.5), ("b", "c", 1.0), ("b", "b", 1.0)), "max")])
    physical = plan(out).rsplit("== physical plan ==", 1)[1].split("== initial plan ==")[0]
    assert sorted((r["a"], r["b"], r["weight"]) for r in out.collect()) == [("a", "d", 3.0), ("b", "c", 1.0)]
    # edges by their greater end, rows by their lesser one, nodes for each; before, pairs by both ends came first
    assert physical.count("exchange hashpartitioning") == 4
