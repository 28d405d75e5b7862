"""Invariants and brute force for the graph, its building, and the retrieval tools."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from velarium.functions import text
from velarium.operators import graph as G
from velarium.operators import kgbuild as K
from velarium.operators import metrics as M
from velarium.operators import records as R
from velarium.operators import retrieval as T
from velarium.operators import search as S
from velarium.operators import store
from velarium.plans import models, registry
from velarium.queries import QUERIES


def ring(n, extra=()):
    return [(i, (i + 1) % n, 1.0) for i in range(n)] + list(extra)


def cliques(sizes):
    edges, start, ends = [], 0, []
    for n in sizes:
        edges += [(start + a, start + b, 1.0) for a, b in itertools.combinations(range(n), 2)]
        ends.append(start)
        start += n
    return edges + [(a, b, 0.1) for a, b in itertools.pairwise(ends)]


def brute_modularity(edges, label):
    m = sum(w for *_, w in edges)
    degree, inside = Counter(), Counter()
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        inside[label[a]] += w if label[a] == label[b] else 0
    return sum(inside[c] / m - (d / (2 * m)) ** 2 for c, d in degree.items())


# walks


@pytest.mark.parametrize("options", [{}, {"weighted": True}, {"p": 0.25, "q": 4.0}, {"weighted": True, "p": 2.0, "q": 0.5}])
def test_walks_go_along_edges(spark, options):
    rows = [(a, b, float(1 + (a * b) % 3)) for a, b, _ in cliques([4, 5, 3])]
    found = G.walks(spark.createDataFrame(rows, "src long, dst long, weight double"), 3, 8, **options).collect()
    either = {(a, b) for a, b, _ in rows} | {(b, a) for a, b, _ in rows}
    assert Counter(r["path"][0] for r in found) == Counter({n: 3 for n in range(12)})
    assert len({r["walk"] for r in found}) == len(found)
    for r in found:
        assert len(r["path"]) == 8 and all(s in either for s in itertools.pairwise(r["path"]))


def test_biased_walks_follow_their_distribution(spark):
    # a triangle 0 1 2 with a tail 2 3: from 1 to 2 the next is 1 (back), 0 (near 1) or 3 (away)
    rows = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 2.0)]
    p, q = 0.5, 4.0
    found = G.walks(spark.createDataFrame(rows, "src long, dst long, weight double"), 3000, 3, weighted=True, p=p, q=q).collect()
    after = Counter(r["path"][2] for r in found if r["path"][:2] == [1, 2])
    mass = {1: 1 / p, 0: 1.0, 3: 2.0 / q}
    total = sum(mass.values())
    n = sum(after.values())
    assert n > 1000
    for k, w in mass.items():
        assert abs(after[k] / n - w / total) < 0.05
    first = Counter(r["path"][1] for r in found if r["path"][0] == 2)
    assert abs(first[3] / sum(first.values()) - 0.5) < 0.05


def test_node_embeddings_hold_every_node(spark):
    edges = spark.createDataFrame(cliques([3, 4]), "src long, dst long, weight double")
    vectors = G.node_embeddings(G.walks(edges, 2, 6), size=8, window=3).collect()
    assert {r["node"] for r in vectors} == {str(k) for k in range(7)} and all(len(r["vector"]) == 8 for r in vectors)


# communities


def test_label_propagation_says_whether_it_settled(spark):
    edges = spark.createDataFrame(cliques([4, 4]), "a long, b long, weight double")
    settled = G.communities(edges, 30).collect()
    assert all(r["settled"] for r in settled) and len({r["community"] for r in settled}) == 2
    assert not any(r["settled"] for r in G.communities(edges, 1).collect())


# lineage and traversal


def test_lineage_goes_on_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)], "parent string, child string")
    roots = spark.createDataFrame([("n0",)], "node string")
    assert {(r["child"], r["depth"]) for r in G.lineage(chain, roots).collect()} == {(f"n{i + 1}", i + 1) for i in range(25)}
    with pytest.raises(ValueError):
        G.lineage(chain, roots, levels=2)
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")], "parent string, child string")
    start = spark.createDataFrame([("a",)], "node string")
    assert Counter(r["child"] for r in G.lineage(loop, start).collect()) == {"a": 1, "b": 1, "c": 2}
    assert {r["child"]: r["depth"] for r in G.lineage(loop, start, distinct=True).collect()} == {"a": 2, "b": 1, "c": 1}


def test_traversal_equals_breadth_first_search(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 20)}", rng.choice("xy"), rng.random()) for _ in range(30)]
    found = {r["node"]: (r["path_length"], r["edge_type"]) for r in G.traversal(spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double"), "n0", 3).collect()}
    seen, front, wanted = {"n0"}, {"n0"}, {}
    for n in (2, 3, 4):
        via = [(b, (k, w, a)) for a, b, k, w in edges if a in front and b not in seen] + [(a, (k, w, b)) for a, b, k, w in edges if b in front and a not in seen]
        best = {}
        for node, e in via:
            best[node] = min(e, best.get(node, e))
        wanted |= {node: (n, e[0]) for node, e in best.items()}
        front = set(best)
        seen |= front
    assert found == wanted


# entity resolution


def test_similar_pairs_and_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        centres = rng.normal(size=(4, 8))
        for k in range(25):
            v = centres[rng.integers(4)] + rng.normal(size=8) * 0.4
            rows.append((g, 100 * g + k, [float(x) for x in v], [(int(t), float(w)) for t, w in zip(rng.choice(6, 2, replace=False), rng.random(2), strict=True)]))
    frame = spark.createDataFrame(rows, "g int, key int, v array<double>, s array<struct<term:int,weight:double>>")

    def hybrid(a, b):
        dense = float(np.dot(a[2], b[2]) / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])))
        x, y = dict(a[3]), dict(b[3])
        sparse = sum(w * y.get(t, 0) for t, w in x.items()) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))
        return 0.9 * dense + 0.1 * sparse

    wanted = {(a[0], a[1], b[1]): hybrid(a, b) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and hybrid(a, b) >= 0.6}
    for block in (4, 500):
        found = {(r["g"], r["a"], r["b"]): r["similarity"] for r in G.similar_pairs(frame, "g", "key", "v", 0.6, "s", block=block).collect()}
        assert found == pytest.approx(wanted)
    clusters = {r["key"]: r["cluster"] for r in G.resolved_entities(frame, "g", "key", "v", 0.6, "s").collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        d = np.array([[1 - hybrid(a, b) if a is not b else 0.0 for b in own] for a in own])
        labels = G.average_linkage(np.clip(d, 0, 2), 0.4)
        assert {frozenset(r[1] for r in own if clusters[r[1]] == c) for c in {clusters[r[1]] for r in own}} == {frozenset(own[i][1] for i in np.flatnonzero(labels == c)) for c in set(labels)}


def test_query_clusters_equal_one_matrix_a_group(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    found = {r["vec_id"]: r["cluster"] for r in QUERIES["avg_linkage_clusters"](spark, SMALL).collect()}
    for label in {r["label"] for r in rows}:
        own = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["label"] == label)
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        labels = G.average_linkage(np.clip(1 - x @ x.T, 0, 2), 0.25)
        assert {frozenset(k for k, _ in own if found[k] == c) for c in {found[k] for k, _ in own}} == {frozenset(own[i][0] for i in np.flatnonzero(labels == c)) for c in set(labels)}


def test_resolution_of_clusters(spark):
    rows = [("c1", "a", "Anna", "A woman."), ("c1", "b", "Anna Meier", ""), ("c1", "d", "Dog", "A dog. Brown"), ("c2", "e", "Car", "Red"), ("c3", "f", "X", "fx"), ("c3", "g", "Y", "gy")]
    frame = spark.createDataFrame(rows, "cluster string, local_id string, name string, desc string")
    said = spark.createDataFrame([("c1", 0, "a", "", ""), ("c1", 0, "b", "", ""), ("c1", 1, "b", "Again", "no"), ("c1", 1, "zz", "", "")], "cluster string, group_no int, local_id string, name string, desc string")
    failed = spark.createDataFrame([("c3",)], "cluster string")
    found = {r["local_id"]: r for r in K.resolution(frame, said, failed).collect()}
    assert found["a"]["global_id"] == found["b"]["global_id"] != found["d"]["global_id"]
    assert (found["a"]["canonical_name"], found["a"]["merged_desc"]) == ("A woman", "A woman.")
    assert (found["d"]["canonical_name"], found["d"]["merged_desc"]) == ("Dog", "A dog. Brown")
    assert found["e"]["global_id"].startswith("GLOBAL_") and found["e"]["canonical_name"] == "Car"
    assert all(found[k]["global_id"].startswith("UNRESOLVED_") for k in "fg") and found["f"]["global_id"] != found["g"]["global_id"]
    plain = {r["local_id"]: r for r in K.resolution(frame).collect()}
    assert plain["a"]["global_id"] == plain["d"]["global_id"] and plain["a"]["canonical_name"] == "Anna Meier" and plain["a"]["merged_desc"] == "A woman. A dog. Brown"


def test_stages_are_laid_over_each_other(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "node string")
    e = lambda *rows: spark.createDataFrame(rows, "src string, dst string, weight double")
    found = K.laid_over(nodes, [(e(("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 9.0), ("a", "z", 9.0)), "sum"), (e(("a", "b", 0.5), ("c", "d", 0.5)), "set"), (e(("b", "a", 2.5), ("c", "d", 0.1)), "max"), (e(("a", "b", 7.0), ("a", "c", 7.0)), "absent")])
    assert {(r["a"], r["b"]): r["weight"] for r in found.collect()} == {("a", "b"): 2.5, ("c", "d"): 0.5, ("a", "c"): 7.0}


# text


def test_porter_stems():
    words = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper feudalism:feudal decisiveness:decis formaliti:formal triplicate:triplic formative:form electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust replacement:replac adoption:adopt communism:commun effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
    assert {w: text.porter(w) for w in (x.split(":")[0] for x in words.split())} == dict(x.split(":") for x in words.split())


def test_analysis_goes_beyond_ascii(spark):
    assert text.analyse("Naïve Straße ÜBER東京 x2, Łódź running_fast") == ["naiv", "strass", "uber東京", "x2", "lodz", "run", "fast"]
    frame = spark.createDataFrame([("Éaux Running",), (None,), ("",)], "t string")
    assert [r["a"] for r in frame.select(text.analysed(F.col("t")).alias("a")).collect()] == [["eaux", "run"], None, []]
    assert [r["a"] for r in frame.select(text.without_accents(F.col("t")).alias("a")).collect()] == ["eaux running", None, ""]


def test_look_alikes(spark):
    assert spark.range(1).select(text.spoken_alike(F.lit("C0rn 1ine")).alias("v")).first()["v"] == "com line"
    assert set(text.alike_variants("1rn")) == {"1rn", "lrn", "irn", "1m", "lm", "im"}


def brute_bm25(docs, words):
    n, sizes = len(docs), {k: len(ts) for k, ts in docs.items()}
    mean, out = sum(sizes.values()) / n, {}
    for k, ts in docs.items():
        for w in set(words):
            if tf := ts.count(w):
                df = sum(w in x for x in docs.values())
                out[k] = out.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[k] / mean))
    return out


def test_analysed_bm25_equals_brute_force(spark):
    docs = {r["doc_id"]: text.analyse(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    scores = brute_bm25(docs, text.analyse("Éauons running connections eaux"))
    found = S.bm25_topk(spark.read.parquet(f"{SMALL}/documents.parquet"), "Éauons running connections eaux", 1000, stem=True).collect()
    assert {r["doc_id"]: r["score"] for r in found} == pytest.approx(scores)


def test_text_is_read_once(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "Cat bird")], "doc_id long, text string")
    held = S.held_terms(docs, ["cat", "dog"], "doc_id", "text")
    assert sorted((r["doc_id"], r["dl"], r["held"]) for r in held.collect()) == [(1, 3, ["cat", "cat", "dog"]), (2, 1, ["dog"]), (3, 2, ["cat"])]


# tools


def small_session(spark, **options):
    ocr = spark.createDataFrame([(1, "v1", "u", 7, "the great hall", "th3 great"), (2, "v1", "u", 3, "greet", "great great"), (3, "v2", "u", 1, "nothing", "else"), (4, "v1", "w", 2, "great", "")], "key int, video_id string, user_id string, frame_index int, cleaned_text string, raw_text string")
    return T.Session({"ocr": T.Collection(ocr, ("cleaned_text", "raw_text"))}, lambda _: [1.0], **options)


def test_ocr_search(spark):
    found = T.search_ocr(small_session(spark, user_id="u"), "great", 10).collect()
    assert {r["key"] for r in found} == {1, 2}
    assert next(r for r in found if r["key"] == 1)["highlights"] == ["the <mark>great</mark> hall"]
    assert {r["key"] for r in T.search_ocr(small_session(spark, user_id="u"), "great", 10, fuzzy=False).collect()} == {1, 2}
    padded = T.search_ocr(small_session(spark), "great", 10, ["v1", "v2"], require_match=False).collect()
    assert {r["key"] for r in padded} == {1, 2, 3, 4} and padded[-1]["key"] == 3 and padded[-1]["score"] == 0.0
    assert [r["key"] for r in T.get_ocr_by_video(small_session(spark, user_id="u"), "v1").collect()] == [2, 1]


def test_ocr_query_pieces_come_from_their_text(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = QUERIES["ocr_search"](spark, SMALL).collect()
    assert found
    for r in found:
        for piece in r["highlights"]:
            assert "<mark>" in piece and piece.replace("<mark>", "").replace("</mark>", "") in pages[r["key"]]


def test_invalid_collections_are_an_error(spark):
    with pytest.raises(ValueError):
        T.search_bm25(small_session(spark), "x", ["nothing"])


def test_context_text_holds_the_first_rows(spark):
    rows = QUERIES["kg_rag_context"](spark, SMALL).collect()
    (line,) = QUERIES["kg_context_text"](spark, SMALL).collect()
    wanted = ["=== Knowledge Graph Context ===", "Query: red widget brand nation 1", ""]
    for name, title in (("entities", "Entities"), ("events", "Events"), ("micro_events", "Micro-events"), ("communities", "Communities"), ("graph_context", "Graph Context")):
        own = sorted((r["rank"], r["label"]) for r in rows if r["section"] == name and r["rank"] <= T.LINES[name])
        if own:
            wanted += ["", f"--- {title} ---"] + [f"  - {label}" for _, label in own]
    assert [x for x in line["context"].split("\n") if x] == [x for x in wanted if x]


def test_results_by_handle(spark):
    clock = [0.0]
    results = registry.Results(10, lambda: clock[0])
    rows = spark.range(3)
    h = results.put("t", {"a": 1}, rows)
    assert h == results.put("t", {"a": 1}, spark.range(5)) != results.put("t", {"a": 2}, rows)
    assert results.get(h).count() == 3 and results.accept(h, lambda df: df.filter("id > 0")).count() == 2
    clock[0] = 11.0
    with pytest.raises(KeyError):
        results.get(h)
    results.clear()


def test_catalogue():
    names = [n for n, *_ in T.CATALOGUE.describe()]
    assert len(names) >= 16 and all(about for *_, about in T.CATALOGUE.describe())
    assert set(T.CATALOGUE.select(["kg.search_events", "none"])) == {"kg.search_events"}
    assert set(T.CATALOGUE.select([])) == set(names)
    assert registry.ready(set()) == ["video"] and "asr" in registry.ready({"video", "autoshot"})
    assert registry.stage_settings("a", '{"a": {"n": 1}}') == {"n": 1}
    with pytest.raises(KeyError, match="a, b"):
        registry.stage_settings("c", '{"a": {}, "b": {}}')


def test_cells(spark, tmp_path):
    points = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    query = list(points.first()["embedding"])
    centres = S.fit_cells(points, str(tmp_path / "cells"), 7)
    exact = [r["vec_id"] for r in S.dense_topk(points, query, 10).collect()]
    assert [r["vec_id"] for r in S.search_cells(spark, str(tmp_path / "cells"), centres, query, 10, 7).collect()] == exact
    some = S.search_cells(spark, str(tmp_path / "cells"), centres, query, 10, 3)
    assert len({r["vec_id"] for r in some.collect()} & set(exact)) >= 4
    assert "PartitionFilters: [isnotnull(cell" in some._jdf.queryExecution().toString() or "cell" in some._jdf.queryExecution().toString()
    assert S.stale_cells(100, 200) and not S.stale_cells(10, 90) and not S.stale_cells(100, 150)


def test_model_calls_come_in_batches(spark):
    def call(part):
        if 7 in part:
            raise RuntimeError
        return [2 * x for x in part]

    found = {r["id"]: r["y"] for r in models.in_batches(spark.range(10).coalesce(1), "id", call, "long", "y", size=4).collect()}
    assert found == {k: None if 4 <= k < 8 else 2 * k for k in range(10)}


def test_hashed_encoder_equals_naive(spark):
    rows = [("the cat the",), ("",), (None,), ("dog",)]
    frame = spark.createDataFrame(rows, "t string").select("t", models.hashed_encoder(16)(F.col("t")).alias("v"), F.transform(text.terms(F.col("t")), lambda x: F.xxhash64(x)).alias("h"))
    for r in frame.collect():
        sums = [0.0] * 16
        for h in r["h"] or []:
            sums[h % 16] += -1.0 if (h >> 32) & 1 else 1.0
        length = math.sqrt(sum(x * x for x in sums)) or 1.0
        assert r["v"] == pytest.approx([x / length for x in sums])


# records and stores


def test_percentiles_and_numbers(spark):
    rng = random.Random(3)
    values = [rng.choice([0.1, 0.2, 0.25, rng.random()]) for _ in range(501)] + [None]
    found = M.percentiles(spark.createDataFrame([(v,) for v in values], "s double").repartition(5), "s").first()
    own = np.array([v for v in values if v is not None])
    assert [found["p25"], found["p50"], found["p75"]] == pytest.approx([float(np.quantile(own, p)) for p in (0.25, 0.5, 0.75)], abs=1e-6)
    placed = M.numbered(spark.range(1000).repartition(7), ["id"]).collect()
    assert all(r["id"] == r["number"] for r in placed)
    assert M.vector_size(spark.createDataFrame([(None,), ([1.0, 2.0],)], "v array<double>"), "v") == 2
    assert M.vector_size(spark.createDataFrame([(None,)], "v array<double>"), "v") == 128
    assert M.index_stats({"a": spark.range(1)}) == [("a", 1, ["id:bigint"])]


def test_progress(spark):
    rows = spark.createDataFrame([("a", True, False), ("a", False, False), ("b", False, True), ("b", False, False)], "v string, done boolean, ended boolean")
    assert {r["v"]: r["percent"] for r in M.progress(rows, "v", F.col("done"), F.col("ended")).collect()} == {"a": 50.0, "b": 100.0}


def test_store_transitions(spark):
    users = spark.createDataFrame([("u1", "l1", "m1"), ("u2", "l2", "m2")], "user_id string, login_id string, email string")
    logins = spark.createDataFrame([("l9", "m2"), ("l8", "m8")], "login_id string, email string")
    after, groups = store.inserted_users(users, logins)
    assert {(r["user_id"], r["login_id"]) for r in after.collect()} == {("u1", "l1"), ("u2", "l9"), ("user_l8", "l8")}
    assert [(r["user_id"], r["name"]) for r in groups.collect()] == [("user_l8", "default")]
    sessions = spark.createDataFrame([("s1", "u1", 1, 5)], "session_id string, user_id string, created int, last_updated int")
    messages = spark.createDataFrame([("s1", "u1", 9), ("s2", "u2", 4), ("s2", "u2", 6)], "session_id string, user_id string, at int")
    assert {tuple(r) for r in store.touched_sessions(sessions, messages).collect()} == {("s1", "u1", 1, 9), ("s2", "u2", 4, 6)}
    picks = spark.createDataFrame([("g1", 1), ("g2", 2)], "group_id string, video int")
    left = store.deleted_group({"groups": (picks.select("group_id"), "group_id"), "picks": (picks, "group_id")}, spark.createDataFrame([("g1",)], "group_id string"))
    assert [r["video"] for r in left["picks"].collect()] == [2] and left["groups"].count() == 1
    rows = spark.createDataFrame([(1, 10, None), (2, 20, "r0")], "video_id int, status int, run_id string")
    new = spark.createDataFrame([(1, 50, "r1"), (2, 60, "r2")], "video_id int, status int, run_id string")
    assert {tuple(r) for r in store.run_status(rows, new).collect()} == {(1, 50, "r1"), (2, 60, "r0")}
    right = spark.createDataFrame([(1, 5, "a"), (1, 3, "z")], "k int, n int, s string")
    left_rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert {tuple(r) for r in store.left_default(left_rows, right, ["k"], {"n": 0, "s": ""}, "s").collect()} == {(1, 3, "z"), (2, 0, "")}
    assert {tuple(r) for r in store.left_default(left_rows, right, ["k"], {"n": 0, "s": ""}).collect()} == {(1, 5, "a"), (2, 0, "")}


def test_small_store_operators(spark):
    rows = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert [r["v"] for r in store.filled(rows, "v", "x").orderBy("k").collect()] == ["x", "b"]
    assert [r["v"] for r in store.renamed_row(rows, "k", 2, "v", "c").orderBy("k").collect()] == [None, "c"]
    points = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "k string, v array<double>")
    assert [r["v"] for r in store.points(points, "k", {"v": 2}, ["k"]).orderBy("id").collect()] == [[1.0, 2.0], None]
    both = spark.range(1).select(store.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first()["m"]
    assert both == {"a": "1", "b": "3"}


def test_tables_are_made_once(spark):
    spark.sql("DROP TABLE IF EXISTS made_once")
    assert store.create_table(spark, "made_once", "a int") and not store.create_table(spark, "made_once", "a int")
    spark.sql("DROP TABLE made_once")


def test_record_shapes(spark):
    rows = spark.createDataFrame([(1, 0.5, "v", "00:00:01.000", 25, "s3://b/x")], "rank int, score double, video_id string, timestamp string, frame_index int, image_uri string")
    assert R.shown(rows, "image").columns == ["rank", "score", "video_id", "time", "frame", "image_uri"]
    with pytest.raises(ValueError):
        R.shown(rows, "text")
    with pytest.raises(Exception, match="missing nope"):
        R.typed(rows, {"nope": "int"}).collect()
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    left = value(R.without_id(F.array(F.struct(F.lit(1).alias("id")), F.struct(F.lit(2).alias("id"))), 1))
    assert [r["id"] for r in left] == [2]
    assert value(R.first_answer([F.lit("no json"), F.lit('```json\n{"a": 3}\n```')], "a int"))["a"] == 3
    facts = value(R.compact_record(F.array(F.lit("plain"), F.lit('{"fact": "f", "source": "s"}'), F.lit(""))))
    assert [(f["fact"], f["source"]) for f in facts] == [("plain", None), ("f", "s")]
