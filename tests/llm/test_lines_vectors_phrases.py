"""Line dedup, dual-tree clusters and collocations against brute force and their SQL."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.comparing import same
from tests.conftest import SMALL
from velarium.llm import collocations, dual_tree, line_dedup, queries

LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "a line that is repeated in many documents, é东𝒳 and all"
NAMES = ("rank", "k", "w", "f", "n", "lang2", "words", "phrase", "digest", "id", "cluster", "held")


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_dual_tree_clusters", "op13_collocations"])
@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_query_equals_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    same(queries.QUERIES[name](spark, folder), con.sql(queries.ORACLE_SQL[name]))


# lines

LINES = [
    (1, LONG), (2, f"  {LONG}\t\n{LONG}\nshort"), (3, f"\x0b{LONG}\r\n\n"), (4, LONG.replace("a line", "A LINE")), (5, f"x\n{LONG}"), (6, f"{LONG}\ny"), (6, f"{LONG}\ny"),
    (7, None), (8, ""), (9, "\n\n"), (None, LONG), (None, LONG), (None, None), (10, "b" * 39), (11, "b" * 39), (12, "b" * 39), (13, "b" * 39), (14, "b" * 39), (15, "b" * 39),
    (16, "\n".join(f"{LONG} {k % 700}" for k in range(6000))), (17, "\n".join(f"{LONG} {k % 700}" for k in range(5))), *((20 + k, f"{LONG} 3\n{LONG} 4") for k in range(4)), (30, f"{LONG} 4\n{LONG} 4"),
    *((40 + k, "é" * 40) for k in range(5)), *((50 + k, "é" * 39) for k in range(5)),
]


def brute_lines(rows, least_chars=40, least_rows=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least_rows}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines_equal_brute_force(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").withColumns({c: F.lit(c) for c in NAMES}).repartition(3)
    found = line_dedup.drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = found.collect()
    assert all(r["rank"] == "rank" and r["digest"] == "digest" for r in rows)
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in rows) == brute_lines(LINES)
    assert any(r["n_dropped"] for r in rows)


def test_lines_of_null_ids_alone_stay(spark):
    rows = [(None, LONG)] * 6
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [x[:2] for x in brute_lines(rows)]


def test_lines_without_rows(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_need_no_python(spark):
    plan = queries.op11_line_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# vectors


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    label = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))[1]
    for _ in range(rounds):
        own = [label(v) for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), n in zip(kept, own, strict=True) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, label(v), far(v, centroids[label(v)])) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    return sorted((str(i), c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def report(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in NAMES}).repartition(3)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in dual_tree.cluster_report(frame, **options).collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=64)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[5][1]), (600, None), (601, [0.5] * 63), (602, [None] * 64), (603, [float("nan")] * 64), (604, [float("inf")] * 64), (605, []), (606, [0.0] * 64), (607, [-0.0] * 64)]
    assert report(spark, rows, block=100, leaf=4) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)] + [(9, [1.0] * 64)]
    assert report(spark, rows) == brute_clusters(rows)
    assert report(spark, []) == [] and report(spark, [(1, None)]) == []


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        report(spark, [(1, [1e30] * 64)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 30), st.integers(1, 6), st.integers(1, 40), st.integers(0, 10**6), st.integers(1, 9))
def test_dual_trees_find_the_nearest(n, k, dims, spread, seed, leaf):
    rng = np.random.default_rng(seed)
    points, centroids = rng.integers(-spread, spread + 1, (n, dims)), rng.integers(-spread, spread + 1, (k, dims))
    tree = dual_tree.CoverTree.of(points, leaf)
    assert sorted(tree.order.tolist()) == list(range(n))
    points = points[tree.order]
    d = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert dual_tree.nearest(points, tree, centroids)[0].tolist() == d.argmin(1).tolist()
    for node in range(len(tree.low)):
        own = points[tree.low[node] : tree.high[node]]
        assert (np.sqrt(((own - points[tree.centre[node]]) ** 2).sum(1)) <= tree.radius[node]).all()


def test_dual_trees_prune():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-1000, 1000, (16, 8))
    points = np.concatenate([c + rng.integers(-5, 6, (100, 8)) for c in centroids])
    tree = dual_tree.CoverTree.of(points, 8)
    labels, compared = dual_tree.nearest(points[tree.order], tree, centroids)
    assert compared < 0.05 * len(points) * len(centroids)
    assert (labels == ((points[tree.order][:, None] - centroids[None]) ** 2).sum(2).argmin(1)).all()


# phrases


def brute_phrases(rows, least=30, cover=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found, covered = [], Counter()
        for p, a in f.items():
            if len(p) > 2 and a >= least:
                for m in range(2, len(p)):
                    for s in range(len(p) - m + 1):
                        covered[p[s : s + m]] = max(covered[p[s : s + m]], a)
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (covered[p] and 100 * covered[p] >= cover * a):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n + 1, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrases(spark, rows, **options):
    frame = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(0) for c in NAMES}).repartition(3)
    found = collocations.collocations(frame, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


WORDS = "Alpha beta, gamma\tdelta; é東 x\x0by z\x00q 𝒳".split(" ")


def _rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(" ".join(WORDS[min(int(x), len(WORDS) - 1)] for x in rng.exponential(1.5, rng.integers(0, 60))), (None, "en", "fr", "und")[rng.integers(4)]) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), (" \t ", "fr"), (".,;", "fr"), ("new york city " * 40, "en"), ("one", None)] + [("a b c d e\n", "fr")] * 35


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"cells": (8, 8)}), (3, {"cells": (64, 256), "least": 7, "top": 5}), (4, {"least": 3, "cover": 50, "sketches": 1})])
def test_phrases_equal_brute_force(spark, seed, options):
    rows = _rows(seed, 120)
    found = phrases(spark, rows, **options)
    assert found == brute_phrases(rows, **{k: v for k, v in options.items() if k in ("least", "cover", "top")}) and len(found) > 4


def test_very_long_text(spark, monkeypatch):
    rows = [("the same few words over and over " * 8000, "en"), ("x " * 70_000, "en")]
    monkeypatch.setattr(collocations, "STRETCH", 1000)
    assert phrases(spark, rows) == brute_phrases(rows)


def test_no_phrases(spark):
    assert phrases(spark, []) == [] and phrases(spark, [(None, None)]) == []


def test_words_are_those_of_the_rule():
    texts = ["A b,c", None, "", "..x", "é\x1fy\tz\x0cw", " lead", "trail ", "no"]
    words = collocations.Words(pa.array(texts, pa.string()), pa.array(["l"] * len(texts)))
    pieces = [re.findall(r"[^\x20\x09]+", p) for t in texts for p in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER))]
    assert words.words.to_pylist() == [w for p in pieces for w in p]
    assert words.left.tolist() == [len(p) - k for p in pieces for k in range(len(p))]


def test_sketch_lets_nothing_frequent_go(spark):
    rows = _rows(9, 60)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    bits = collocations.sketch(docs, F.col("text"), F.coalesce("lang", F.lit("und")), 5, 12, 3)
    words = collocations.Words(pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()))
    word, lang = words.hashes()
    for k, h in collocations.phrase_hashes(word, lang):
        own = h[words.left[: len(h)] >= k]
        kinds, n = np.unique(own, return_counts=True)
        a, b = collocations.cells_of(kinds, 12)
        reached = collocations._reached(bits[0], a) & collocations._reached(bits[1], b)
        assert reached[n >= 5].all()
        assert k == 1 or not reached.all()
