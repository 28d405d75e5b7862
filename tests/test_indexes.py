"""Stored indexes of text and vectors against scans."""

from __future__ import annotations

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from velarium.operators import search as S
from velarium.operators.textindex import TextIndex, automatic_edits, shortened

LETTERS = "abcd"


def _texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.choice((1, 2, 3, 3, 4, 5, 6))))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(30)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "ab " * 500), (n + 3, "x" * 40 + " y" + "z" * 33), (n + 4, "x" * 39 + "w"), (n + 5, "ab cd"), (n + 6, "ab cd")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(_texts(1, 300), "id long, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    out = TextIndex(spark, str(tmp_path_factory.mktemp("index") / "one"), shards=8, blocks=24)
    for part in (F.col("id") % 3 == 0, F.col("id") % 3 == 1, F.col("id") % 3 == 2):
        out.add(texts.filter(part), "id", "text")
    return out


def rows(frame):
    return sorted((r[0], round(r[1], 9)) for r in frame.collect())


@pytest.mark.parametrize("words", [["ab"], ["ab", "cd", "abc", "nothing"], ["a", "b", "c", "d", "aa"], ["nothing"], []])
def test_scores_equal_a_scan(texts, index, words):
    scan = S.bm25(texts, words, "id")
    assert rows(index.scores(words)) == rows(scan)
    for k in (1, 7, 400):
        best = [tuple(r) for r in index.best(words, k, first=2).collect()]
        assert [(r[0], round(r[1], 9)) for r in best] == [(r[0], round(r[1], 9)) for r in S.top(scan, k, "id").collect()]


def test_merged_segments_give_the_same(texts, spark, tmp_path):
    one = TextIndex(spark, str(tmp_path / "m"), shards=4, blocks=8)
    one.add(texts.filter("id < 100"), "id", "text")
    before = rows(one.scores(["ab", "cd"]))
    one.add(texts.filter("id >= 100"), "id", "text")
    one.merge()
    assert len(one._live()[0]) == 1
    assert rows(one.scores(["ab", "cd"])) == rows(S.bm25(texts, ["ab", "cd"], "id")) != before


def test_an_index_of_nothing(spark, tmp_path):
    one = TextIndex(spark, str(tmp_path / "none"), shards=2)
    one.add(spark.createDataFrame([(1, None)], "id long, text string"), "id", "text")
    assert one.scores(["a"]).collect() == [] == one.best(["a"]).collect() and one.near_terms(["abc"]).collect() == []


def test_a_question_reads_its_terms_alone(index):
    found = index._of("postings", index._live()[0], "term", ["ab"])
    shard = index.spark.range(1).select(index._shard(F.lit("ab"))).first()[0]
    plan = found._jdf.queryExecution().toString()
    assert all(f"shard={shard}/" in f for f in found.inputFiles()) or "shard#" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,ab)]" in plan or "In(term" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*shard", plan)
    read = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert read and all(f"shard={shard}/" in f for f in read)


def test_blocks_that_cannot_reach_are_skipped(spark, tmp_path):
    docs = spark.createDataFrame([(k, "common " * (1 + 40 * (k < 3)) + "other " * 20) for k in range(400)], "id long, text string")
    one = TextIndex(spark, str(tmp_path / "skip"), shards=2, blocks=100)
    one.add(docs, "id", "text")
    seen = []
    real = TextIndex._scored

    def counted(self, postings, weights, average):
        seen.append(postings.count())
        return real(self, postings, weights, average)

    TextIndex._scored = counted
    try:
        best = one.best(["common"], 3, first=3).collect()
    finally:
        TextIndex._scored = real
    assert {r["key"] for r in best} == {0, 1, 2} and max(seen) < 40


@pytest.mark.parametrize("words", [["abcd"], ["ab", "abc", "dcbab"], ["x" * 40], ["y" + "z" * 30], ["q"], []])
def test_near_terms_equal_a_scan(texts, index, words):
    for most in (3, 50):
        assert sorted(map(tuple, index.near_terms(words, most).collect())) == sorted(map(tuple, S.fuzzy_terms(texts, " ".join(words), "text", most).collect()))


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
        last = row
    return last[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=8), st.text(LETTERS, max_size=8))
def test_near_words_share_what_is_left(a, b):
    for most in (0, 1, 2):
        if distance(a, b) <= most:
            assert shortened(a, most) & shortened(b, 2)
    assert automatic_edits("ab") == 0 and automatic_edits("abcde") == 1 and automatic_edits("abcdef") == 2


# vectors


@pytest.fixture(scope="module")
def points(spark):
    own = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    odd = spark.createDataFrame([(10_000, [0.0] * 64), (10_001, None), (10_002, [1.0] * 64), (10_003, [2.0] * 64)], "vec_id long, embedding array<double>")
    return own.unionByName(odd)


@pytest.fixture(scope="module")
def vectors(spark, points, tmp_path_factory):
    return S.VectorIndex(spark, str(tmp_path_factory.mktemp("vectors") / "one")).build(points, 12)


def test_searches_equal_scans(points, vectors):
    asked = [list(r["embedding"]) for r in points.filter("embedding IS NOT NULL AND vec_id % 40 = 3").collect()] + [[1.0] * 64, [-1.0] + [0.0] * 63]
    for q in asked:
        assert [tuple(r)[0] for r in vectors.search(q, 10).select("vec_id").collect()] == [r["vec_id"] for r in S.dense_topk(points, q, 10).collect()]
    assert len(vectors.search([1.0] * 64, 600).collect()) == min(600, points.count())


def test_far_cells_are_not_read(spark, tmp_path):
    rng = random.Random(2)
    rows_ = [(k, [math.cos(a), math.sin(a), 0.01 * rng.random()]) for k in range(600) for a in [2 * math.pi * (k % 12) / 12 + 0.02 * rng.random()]]
    points = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    index = S.VectorIndex(spark, str(tmp_path / "v")).build(points, 12)
    q = rows_[5][1]
    found = index.search(q, 10)
    assert [r["vec_id"] for r in found.collect()] == [r["vec_id"] for r in S.dense_topk(points, q, 10).collect()]
    read = {f for r in index._within([c["cell"] for c in index.cells(q).filter("least <= 0.3").collect()]).select(F.input_file_name()).distinct().collect() for f in r}
    assert len(read) <= 3 < len(index.points().inputFiles())
    assert re.search(r"PartitionFilters: \[[^\]]*cell", found._jdf.queryExecution().toString())


def test_probes_give_the_recall(points, vectors):
    asked = [list(r["embedding"]) for r in points.filter("vec_id % 10 = 7").collect()]
    probes = vectors.probes_for(asked, 10, 0.9)
    hits = total = 0
    for q in asked[:12]:
        exact = {r["vec_id"] for r in S.dense_topk(points, q, 10).collect()}
        hits += len(exact & {r["vec_id"] for r in vectors.search(q, 10, probes=probes).collect()})
        total += len(exact)
    assert probes <= 12 and hits / total >= 0.85
    assert vectors.probes_for(asked, 10, 1.0) >= probes


def test_an_index_without_directions(spark, tmp_path):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    index = S.VectorIndex(spark, str(tmp_path / "z")).build(points)
    assert [r["vec_id"] for r in index.search([1.0, 0.0], 5).collect()] == [r["vec_id"] for r in S.dense_topk(points, [1.0, 0.0], 5).collect()]


def test_cells_are_bounded_by_the_sample():
    assert [S._cells(n, 100_000) for n in (0, 10, 2_000, 100_000, 7_000_000, 10**9)] == [1, 3, 44, 316, 390, 390]


def test_nearest_of_each_equals_scans(spark, points):
    many = points.unionByName(points.filter("vec_id < 20").select((F.col("vec_id") + 50_000).alias("vec_id"), "embedding")).repartition(3)
    asked = [list(r["embedding"]) for r in points.filter("embedding IS NOT NULL AND vec_id % 50 = 3").collect()] + [[1.0] * 64]
    found = S.nearest_of_each(many, asked, 7).orderBy("q", F.col("score").desc(), "vec_id").collect()
    for n, q in enumerate(asked):
        assert [r["vec_id"] for r in found if r["q"] == n] == [r["vec_id"] for r in S.dense_topk(many, q, 7).collect()]


def test_folders_of_cells_are_listed_once(vectors):
    assert vectors.points() is vectors.points()


def test_terms_keep_few_variants_and_near_ones_are_found(spark, tmp_path):
    words = ["abcdefghijklmnop", "abxdefghijklmnop", "abcdefghijklmno", "xabcdefghijklmnopq", "cdefghijklmnop", "abcdefghijk" * 4, "abcdefghijk" * 4 + "zz", "bacdefghijklmnop", "abcdefgh"]
    docs = spark.createDataFrame([(k, f"{w} {w} common") for k, w in enumerate(words)], "id long, text string")
    one = TextIndex(spark, str(tmp_path / "variants"), shards=2)
    one.add(docs, "id", "text")
    asked = ["abcdefghijklmnop", "abcdefghijk" * 4, "abcdefghi"]
    assert sorted(map(tuple, one.near_terms(asked).collect())) == sorted(map(tuple, S.fuzzy_terms(docs, " ".join(asked), "text").collect()))
    assert one._read("variants", *one._live()[0]).groupBy("term").count().agg(F.max("count")).first()[0] <= 29


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14))
def test_near_words_share_what_is_left_of_their_beginnings(a, b):
    for most in (0, 1, 2):
        if distance(a, b) <= most:
            assert shortened(a[:7], most) & shortened(b[:7], 2)
