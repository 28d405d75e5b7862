"""Vector, text and fused search. Every ranking ends with the key, so results are total orders.

Query vectors, terms and weights are arguments, so what is broadcast is bounded by the query. A text search reads the text once and goes on with the
occurrences of the query's terms.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from velarium.functions import text as T
from velarium.functions import vector as V
from velarium.operators.scope import above, in_scope, top
from velarium.operators.textindex import automatic_edits
from velarium.shared import cut, own_dir, ship

K1, B = 1.2, 0.75
RRF_K, ABSENT_RANK, DEPTH = 60, 101, 50


# dense and sparse vectors


def dense_topk(points: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding", least: float | None = None, **scope) -> DataFrame:
    """The k points of greatest cosine with the query vector, inside the scope and strictly above `least`."""
    scored = in_scope(points, **scope).withColumn("score", V.cosine(F.col(vector), V.literal(query)))
    return top(above(scored, least), k, key)


def dense_topk_by_group(points: DataFrame, query: list[float], group: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """The k best of each group; the limit is taken before the shuffle (WindowGroupLimit)."""
    scored = above(points.withColumn("score", V.cosine(F.col(vector), V.literal(query))), least)
    order = Window.partitionBy(group).orderBy(F.col("score").desc_nulls_last(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sparse_postings(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf) of an array column of terms."""
    return docs.select(F.col(key), F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def sparse_topk(postings: DataFrame, query: dict[str, float], k: int = 10, key: str = "doc_id", weight: str = "tf") -> DataFrame:
    """The k keys of greatest sparse dot product; only rows of query terms are read."""
    if not query:
        return postings.select(key, F.lit(0.0).alias("score")).limit(0)
    of = F.create_map(*[F.lit(x) for kv in sorted(query.items()) for x in kv])
    hit = postings.filter(F.col("term").isin(*sorted(query)))
    scored = hit.groupBy(key).agg(F.sum(F.col(weight).cast("double") * F.element_at(of, F.col("term")).cast("double")).alias("score"))
    return top(scored, k, key)


# BM25


Analyzer = Callable[[Column], Column]


def held_terms(docs: DataFrame, wanted: list[str], key: str, field: str, analyzer: Analyzer | None = None) -> DataFrame:
    """(key, dl, held) of every document with text: its length in terms and its occurrences of the wanted terms. One pass over the text, kept in the shared folder."""
    # beyond an explode no filter or projection is pushed that would split the text again
    split = docs.filter(F.col(field).isNotNull()).select(F.col(key), F.explode(F.array((analyzer or T.terms)(F.col(field)))).alias("terms"))
    return cut(split.select(key, F.size("terms").alias("dl"), F.filter("terms", lambda t: t.isin(*wanted)).alias("held")))


def bm25(docs: DataFrame, query_terms: list[str], key: str = "doc_id", field: str = "text", terms: Analyzer | None = None) -> DataFrame:
    """(key, score) of the documents that hold a query term.

    `terms` maps the field to an array of terms (lower-case letters and digits by default). Only occurrences of the query's terms leave the pass over the text; document
    frequencies are at most one row a term, and the score of a document is a projection. Nothing is shuffled but the frequencies.
    """
    wanted = sorted(set(query_terms))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    held = held_terms(docs, wanted, key, field, terms)
    tf = F.transform(F.array_distinct("held"), lambda w: F.struct(w.alias("term"), F.size(F.filter("held", lambda t: t == w)).alias("tf")))
    hits = held.filter(F.size("held") > 0).select(key, "dl", tf.alias("tf"))
    df = hits.select(F.explode("tf.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).join(F.broadcast(df.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))))
    every = hits.join(F.broadcast(stats))  # one row

    def part(x: Column) -> Column:
        d = F.element_at("df", x["term"])
        idf = F.log(1.0 + (F.col("n") - d + 0.5) / (d + 0.5))
        return idf * x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    # in order of the terms, so that a sum does not hang on where they stand in the text
    ordered = F.array_sort("tf")
    return every.select(key, F.aggregate(ordered, F.lit(0.0), lambda s, x: s + part(x)).alias("score"))


def bm25_topk(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", field: str = "text", least: float | None = None, stem: bool = False, **scope) -> DataFrame:
    words, analyzer = analysed_query(query, stem)
    return top(above(bm25(in_scope(docs, **scope), words, key, field, analyzer), least), k, key)


def query_words(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def analysed_query(query: str, stem: bool) -> tuple[list[str], Analyzer | None]:
    """The words of a query and the analyzer of its fields: lower-case without accents and stemmed, or plain ASCII terms."""
    return (T.analyse(query), T.analysed) if stem else (query_words(query), None)


def best_field(docs: DataFrame, query: str, fields: dict[str, float], k: int = 10, key: str = "doc_id", require_match: bool = True) -> DataFrame:
    """The greatest of the boosted BM25 scores of several fields; without `require_match` other documents pad the result at zero."""
    best = _best_of_fields(docs, dict.fromkeys(fields, query_words(query)), fields, key)
    if not require_match:
        best = docs.select(key).join(best, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))
    return top(best, k, key)


def _best_of_fields(docs: DataFrame, words: dict[str, list[str]], boosts: dict[str, float], key: str) -> DataFrame:
    scored = [bm25(docs, words[f], key, f).select(key, (F.col("score") * boost).alias("score")) for f, boost in boosts.items()]
    return reduce(DataFrame.unionByName, scored).groupBy(key).agg(F.max("score").alias("score"))


def fuzzy_terms(docs: DataFrame, query: str, field: str = "text", most: int = 50) -> DataFrame:
    """(term, edits) of the vocabulary within the allowed edits of a query term: the `most` nearest of each, ties by term.

    One pass over the text makes the vocabulary, of terms of fitting length alone; each is held against all words of the query in a projection.
    """
    words = sorted(set(query_words(query)))
    if not words:
        return docs.select(F.lit("").alias("term"), F.lit(0).alias("edits")).limit(0)
    allowed = {w: automatic_edits(w) for w in words}
    shortest, longest = min(len(w) - n for w, n in allowed.items()), max(len(w) + n for w, n in allowed.items())
    vocabulary = docs.select(F.explode(T.terms(F.col(field))).alias("term")).filter(F.length("term").between(shortest, longest)).distinct()
    edits = F.array(*[F.struct(F.lit(w).alias("word"), F.levenshtein("term", F.lit(w), n).alias("edits")) for w, n in allowed.items()])
    near = vocabulary.select("term", F.explode(F.filter(edits, lambda x: x["edits"] >= 0)).alias("x")).select("term", "x.word", "x.edits")
    place = F.row_number().over(Window.partitionBy("word").orderBy("edits", "term"))
    return near.withColumn("place", place).filter(F.col("place") <= most).groupBy("term").agg(F.min("edits").alias("edits"))


def bm25_fuzzy(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", field: str = "text", most: int = 50) -> DataFrame:
    """BM25 over the query's fuzzy expansion: at most `most` terms a query term, as text engines bound it."""
    words = [r["term"] for r in fuzzy_terms(docs, query, field, most).collect()]
    return top(bm25(docs, words, key, field), k, key)


def text_search(docs: DataFrame, query: str, fields: dict[str, float], k: int = 10, key: str = "doc_id", fuzzy: bool = True, marked: str | None = None, size: int = 200, pieces: int = 3, most: int = 50, **scope) -> DataFrame:
    """Text of images as one search: any term of the query, fuzzy by its length, the best of the boosted fields; (key, score, highlights).

    `highlights` are pieces of the field `marked` that hold a term of the expansion, with the terms in marks. Ties go by key.
    """
    docs = in_scope(docs, **scope)
    words = {f: [r["term"] for r in fuzzy_terms(docs, query, f, most).collect()] if fuzzy else query_words(query) for f in fields}
    best = top(_best_of_fields(docs, words, fields, key), k, key)
    if marked is None:
        return best
    # at most k rows meet their text
    own = docs.join(F.broadcast(best), key)
    shown = T.fragments(F.coalesce(F.col(marked), F.lit("")), words[marked], size, pieces) if words[marked] else F.array().cast("array<string>")
    return top(own.select(key, "score", shown.alias("highlights")), k, key)


def text_of_video(docs: DataFrame, video: str, video_id, order: str, limit: int = 1000, **scope) -> DataFrame:
    """All text rows of a video in frame order, with score 0."""
    return in_scope(docs, **{video: video_id}, **scope).withColumn("score", F.lit(0.0)).orderBy(order).limit(limit)


# fusion


def ranked(hits: DataFrame, key: str, depth: int = DEPTH, score: str = "score") -> DataFrame:
    """(key, rank) of the `depth` best, from 1."""
    best = top(hits, depth, key, score).select(key, score)
    return best.select(key, F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), F.col(key))).alias("rank"))


def reciprocal_ranks(lists: dict[str, DataFrame], key: str, k: int = 10, constant: int = RRF_K, absent: int | None = ABSENT_RANK, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse ranked lists: the sum of weight / (constant + rank); a missing list counts as rank `absent`, or nothing if that is None."""
    joined = None
    for name, hits in lists.items():
        one = hits.select(F.col(key), F.col("rank").alias(f"{name}_rank"))
        joined = one if joined is None else joined.join(one, key, "full")
    total = F.lit(0.0)
    for name in lists:
        w, r = float((weights or {}).get(name, 1.0)), F.col(f"{name}_rank")
        missing = F.lit(0.0) if absent is None else F.lit(w / (constant + absent))
        total = total + F.coalesce(F.lit(w) / (F.lit(constant) + r), missing)
    return top(joined.withColumn("rrf_score", total), k, key, "rrf_score")


def hybrid(docs: DataFrame, points: DataFrame, query: str, vector: list[float], k: int = 10, key: str = "doc_id", least: float | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Text, vector and, if given, graph candidates fused; points are keyed like documents."""
    lists = {"text": ranked(bm25(docs, query_words(query), key), key), "vector": ranked(above(points.withColumn("score", V.cosine(F.col("embedding"), V.literal(vector))), least), key)}
    if extra is not None:
        lists["graph"] = extra
    return reciprocal_ranks(lists, key, k)


# views


def view(hits: DataFrame, mode: str = "brief", n: int = 5, key: str = "doc_id", brief: list[str] | None = None) -> DataFrame:
    """`brief` (few columns) and `detailed` keep the n best by score, else rrf_score, else 0; `full` keeps all."""
    have = [F.col(c).cast("double") for c in ("score", "rrf_score") if c in hits.columns]
    ordered = hits.withColumn("_score", F.coalesce(*have, F.lit(0.0)))
    if mode == "full":
        return ordered.drop("_score")
    best = top(ordered, n, key, "_score").drop("_score")
    return best.select(*(brief or [key, *[c for c in ("score", "rrf_score") if c in hits.columns]])) if mode == "brief" else best


def bucket_label(score: Column) -> Column:
    """`0.5-0.6` for 0.57; scores below zero fall in `0.0-0.1`, as the cut is toward zero."""
    low = (score * 10).cast("int") / 10.0
    return F.format_string("%.1f-%.1f", low, low + 0.1)


def _leading(asked: list[list[float]], k: int, vector: str):
    """Of a task's points with each question's number q those that may be among its k nearest; a hair more than those, as sums are added in another order here."""
    q = np.array(asked, dtype=np.float64)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(q), k), -np.inf)
        for rows in batches:
            at = rows.schema.get_field_index(vector)
            x = rows.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            with np.errstate(all="ignore"):
                score = q @ x.T / np.linalg.norm(x, axis=1)
            real = np.isfinite(score)
            best = np.sort(np.concatenate([best, np.where(real, score, -np.inf)], axis=1), axis=1)[:, -k:]
            n, row = np.nonzero((score >= best[:, :1] - 1e-9) | ~real)
            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(row)).columns, pa.array(n.astype(np.int32))], names=[*rows.schema.names, "q"])

    return run


def nearest_of_each(points: DataFrame, asked: list[list[float]], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The points' columns, q and score: the k points of greatest cosine to each of the vectors asked, ties by key, in one pass over all points that have a direction."""
    spark = points.sparkSession
    ship(spark)
    size = len(asked[0])
    real = points.filter((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull()) & (V.norm(F.col(vector)) > 0))
    some = real.mapInArrow(_leading(asked, k, vector), StructType([*points.schema.fields, StructField("q", IntegerType())]))
    vectors = F.broadcast(spark.createDataFrame([(n, [float(v) for v in q]) for n, q in enumerate(asked)], "q int, _asked array<double>"))
    scored = some.join(vectors, "q").withColumn("score", V.cosine(F.col(vector), F.col("_asked"))).drop("_asked")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc_nulls_last(), F.col(key)))
    return scored.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def statistics(hits: DataFrame, group_by: str, key: str = "vec_id", score: str = "score") -> DataFrame:
    """Count, rounded mean and best item by a column, by `score_bucket`, or over everything as `Unknown`."""
    label = bucket_label(F.col(score)) if group_by == "score_bucket" else F.col(group_by).cast("string") if group_by in hits.columns else F.lit("Unknown")
    best = F.min_by(key, F.struct(F.col(score).isNull(), -F.col(score), key))
    return hits.groupBy(label.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 3).alias("mean_score"), best.alias("best_key"))


#: Points of the sample that a centre is fitted on at least, where the number of cells is not given.
PER_CENTRE = 256


def _cells(n: int, sample: int) -> int:
    """The square root of the points, but no more centres than a bounded sample can place: placing a point then costs the same however many there are, and so does what a turn of k-means sends to the driver, which grows with the square of the centres."""
    return max(1, min(math.isqrt(n), sample // PER_CENTRE))


def fit_cells(points: DataFrame, folder: str, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 1, sample: int = 100_000) -> list[list[float]]:
    """Write all points by k-means cell of their direction, one folder a cell, and give the centres. The centres (`_cells` by default) are fitted on at most about `sample` points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    cells = cells or _cells(n, sample)
    normal = points.withColumn("_features", array_to_vector(V.normalised(F.col(vector))))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    some = normal.filter(place < int((1 << 30) * min(1.0, sample / max(1, n)))).repartition(points.sparkSession.sparkContext.defaultParallelism, key)
    model = KMeans(k=cells, seed=seed, maxIter=40, featuresCol="_features", predictionCol="cell").fit(some)
    model.transform(normal).drop("_features").write.partitionBy("cell").parquet(folder)
    return [list(map(float, c)) for c in model.clusterCenters()]


def search_cells(spark: SparkSession, folder: str, centres: list[list[float]], query: list[float], k: int = 10, probes: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest points in the `probes` cells whose centres are nearest: only their files are read. Exact when every cell is probed."""
    length = math.sqrt(sum(x * x for x in query)) or 1.0
    near = sorted(range(len(centres)), key=lambda c: (sum((a / length - b) ** 2 for a, b in zip(query, centres[c], strict=True)), c))[:probes]
    return dense_topk(spark.read.parquet(folder).filter(F.col("cell").isin(*near)), query, k, key, vector)


def cells_topk(points: DataFrame, query: list[float], k: int = 10, probes: int = 10, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """`fit_cells` and `search_cells` at once, for a table that is asked but once."""
    folder = f"{own_dir(points.sparkSession)}/cells-{uuid.uuid4().hex}"
    return search_cells(points.sparkSession, folder, fit_cells(points, folder, cells, key, vector, seed), query, k, probes, key, vector)


class VectorIndex:
    """Points by k-means cell of their direction, with each cell's centre and the widest angle from it to a point.

    No point of a cell is nearer to a query than the query's angle to the centre less that width. A search takes the cells of least such angle first, and then those that may still hold one of the k
    best; others are never read, and the result is that of a scan. With `probes` it stops at so many cells, and `probes_for` measures how many a recall takes. Centres stay a table; of the cells
    only numbers come to the driver, up to LISTED (more are joined). Points without a direction (null, zero) are a cell of their own, read where fewer than k others are there.
    """

    LISTED = 5000

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", vector: str = "embedding") -> None:
        self.spark, self.folder, self.key, self.vector = spark, folder, key, vector
        self._points: DataFrame | None = None

    def build(self, points: DataFrame, cells: int | None = None, seed: int = 1, sample: int = 100_000) -> VectorIndex:
        """Centres (`_cells` by default) are fitted on about `sample` directions at most; every point is indexed."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector, vector_to_array

        n, x = points.count(), F.col(self.vector)
        real = V.norm(x) > 0
        place = F.pmod(F.xxhash64(F.lit(seed), F.col(self.key)), F.lit(1 << 30))
        # a table of few files is still fitted by all tasks
        some = points.filter(real & (place < int((1 << 30) * min(1.0, sample / max(1, n))))).repartition(self.spark.sparkContext.defaultParallelism, self.key).select(array_to_vector(V.normalised(x)).alias("_f"))
        if some.isEmpty():
            found = points.withColumn("cell", F.lit(-1))
        else:
            model = KMeans(k=cells or _cells(n, sample), seed=seed, maxIter=40, featuresCol="_f", predictionCol="_c").fit(some)
            centres = self.spark.createDataFrame([(c, [float(v) for v in m]) for c, m in enumerate(model.clusterCenters())], "cell int, centre array<double>")
            placed = model.transform(points.filter(real).withColumn("_f", array_to_vector(V.normalised(x))))
            found = placed.withColumn("cell", F.col("_c").cast("int")).drop("_f", "_c").unionByName(points.filter(~F.coalesce(real, F.lit(False))).withColumn("cell", F.lit(-1)))
        found.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.folder}/points")
        if some.isEmpty():
            centres = self.spark.createDataFrame([], "cell int, centre array<double>")
        own = self.points().filter("cell >= 0").join(centres, "cell")
        wide = own.groupBy("cell").agg(F.max(self._angle(F.col(self.vector), F.col("centre"))).alias("width"), F.count(F.lit(1)).alias("n"))
        centres.join(wide, "cell").write.parquet(f"{self.folder}/cells")
        return self

    @staticmethod
    def _angle(a: Column, b: Column) -> Column:
        return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), V.cosine(a, b))))

    def points(self) -> DataFrame:
        """All points; the folders of the cells are listed once and not at each search."""
        if self._points is None:
            self._points = self.spark.read.parquet(f"{self.folder}/points")
        return self._points

    def cells(self, query: list[float]) -> DataFrame:
        """(cell, n, angle, least): the angle to each centre, and the least that a point of the cell may have."""
        angle = self._angle(F.col("centre"), V.literal(query))
        return self.spark.read.parquet(f"{self.folder}/cells").select("cell", "n", angle.alias("angle"), F.greatest(F.lit(0.0), angle - F.col("width") - 1e-7).alias("least"))

    def _within(self, numbers: list[int]) -> DataFrame:
        return self.points().filter(F.col("cell").isin(*numbers))

    def search(self, query: list[float], k: int = 10, first: int = 4, probes: int | None = None) -> DataFrame:
        """The k points of greatest cosine, ties by key; exact unless `probes` says how many cells are read."""
        cells = self.cells(query)
        if probes is not None:
            return dense_topk(self._within([r["cell"] for r in cells.orderBy("angle", "cell").limit(probes).collect()]), query, k, self.key, self.vector)
        lead = [r["cell"] for r in cells.orderBy("least", "angle", "cell").limit(first).collect()]
        begun = dense_topk(self._within(lead), query, k, self.key, self.vector).select("score").collect() if lead else []
        if len(begun) < k:
            return dense_topk(self.points(), query, k, self.key, self.vector)
        bound = math.acos(max(-1.0, min(1.0, begun[-1]["score"])))
        reach = cells.filter(F.col("least") <= bound + 1e-7).select("cell")
        numbers = [r["cell"] for r in reach.limit(self.LISTED + 1).collect()]
        rows = self._within(numbers) if len(numbers) <= self.LISTED else self.points().join(reach, "cell", "left_semi")
        return dense_topk(rows, query, k, self.key, self.vector)

    def probes_for(self, queries: list[list[float]], k: int = 10, recall: float = 0.9) -> int:
        """The least number of cells that gives the recall at k over these queries (a bounded sample), measured against all points."""
        if not queries:
            return 1
        asked = F.broadcast(self.spark.createDataFrame([(n, [float(v) for v in q]) for n, q in enumerate(queries)], "q int, asked array<double>"))
        best = nearest_of_each(self.points().filter("cell >= 0").select(self.key, self.vector, "cell"), queries, k, self.key, self.vector).select("q", "cell")
        turn = F.row_number().over(Window.partitionBy("q").orderBy("angle", "cell"))
        turns = self.spark.read.parquet(f"{self.folder}/cells").join(asked).withColumn("angle", self._angle(F.col("centre"), F.col("asked"))).select("q", "cell", turn.alias("turn"))
        found = best.join(turns, ["q", "cell"]).agg(F.percentile("turn", F.lit(recall)).alias("p")).first()["p"]
        return max(1, math.ceil(found or 1))


def stale_cells(fitted: int, now: int) -> bool:
    """Whether an index over `fitted` points is to be made anew over `now`: from 100 points on, when they have doubled."""
    return now >= 100 and now >= 2 * fitted
