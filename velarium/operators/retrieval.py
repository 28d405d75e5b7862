"""Retrieval over a knowledge graph and media collections, in the scope of a session.

A collection is a table of (key, video_id, user_id, embedding) and text fields. A session holds the collections, the graph's edges between `collection/key` nodes, an encoder
for questions, and the user and videos that a search is limited to. Every tool is a function of the session that gives a table; `call` keeps its result under a handle.
Rankings end with the key, so results are total orders. Vectors never leave a search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.functions import text as T
from velarium.functions import vector as V
from velarium.operators import graph as G
from velarium.operators import search as S
from velarium.operators import temporal
from velarium.operators.metrics import numbered
from velarium.operators.scope import above, in_scope, page, top
from velarium.operators.textindex import TextIndex
from velarium.plans.registry import Registry, Results
from velarium.shared import cut

CATALOGUE = Registry()
#: Collections of the knowledge graph in their order (fixed values).
GRAPH = ("entities", "events", "micro_events", "communities")
#: Rows of each section of a retrieved context, and lines of each in its text (fixed values).
SECTIONS = {"entities": 10, "events": 5, "micro_events": 5, "communities": 3}
LINES = SECTIONS | {"graph_context": 10}


@dataclass(frozen=True)
class Collection:
    """Rows and the text fields that are searched; the first that is not empty names a row. `sparse` has (key, term, weight) postings."""

    rows: DataFrame
    fields: tuple[str, ...]
    sparse: DataFrame | None = None

    def label(self) -> Column:
        return T.first_truthy(*[F.col(f) for f in self.fields])


@dataclass
class Session:
    collections: dict[str, Collection]
    encode: Callable[[str], list[float]]
    edges: DataFrame | None = None
    user_id: str | None = None
    video_ids: list[str] | None = None
    encode_sparse: Callable[[str], dict[str, float]] | None = None
    stem: bool = True
    results: Results = field(default_factory=Results)
    indexes: dict[tuple[str, str], TextIndex] = field(default_factory=dict)

    def index_text(self, folder: str, names: list[str] | None = None) -> None:
        """Write a text index of each text field of the collections; questions of words then read their terms' files only."""
        for name in names or list(self.collections):
            found = self.collections[name]
            for f in found.fields:
                index = TextIndex(found.rows.sparkSession, f"{folder}/{name}/{f}", T.analysed if self.stem else T.terms)
                index.add(found.rows.select("key", F.coalesce(F.col(f), F.lit("")).alias(f)), "key", f)
                self.indexes[name, f] = index

    def scope(self, video_ids: list[str] | None = None) -> dict:
        """What a search is limited to: its argument, or else the session's videos, and the user."""
        return {"video_id": video_ids or self.video_ids, "user_id": self.user_id}

    def within(self, name: str, video_ids: list[str] | None = None) -> DataFrame:
        return in_scope(self.collections[name].rows, **self.scope(video_ids))


def without_vectors(rows: DataFrame) -> DataFrame:
    """Rows without their array columns of numbers."""
    return rows.drop(*[f.name for f in rows.schema if f.dataType.simpleString() in ("array<float>", "array<double>")])


def semantic(session: Session, name: str, query: str, k: int, video_ids: list[str] | None, least: float | None) -> DataFrame:
    """The k rows of a collection nearest to the question, strictly above `least`; null vectors never pass a bound."""
    return without_vectors(S.dense_topk(session.within(name, video_ids), session.encode(query), k, "key", least=least))


@CATALOGUE.add("kg")
def search_entities_semantic(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Entities by meaning."""
    return semantic(session, "entities", query, k, video_ids, least)


@CATALOGUE.add("kg")
def search_events(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Events of segments by meaning."""
    return semantic(session, "events", query, k, video_ids, least)


@CATALOGUE.add("kg")
def search_micro_events(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Events of frames by meaning."""
    return semantic(session, "micro_events", query, k, video_ids, least)


@CATALOGUE.add("kg")
def search_communities(session: Session, query: str, k: int = 5, video_ids: list[str] | None = None, least: float = 0.4) -> DataFrame:
    """Communities by meaning."""
    return semantic(session, "communities", query, k, video_ids, least)


def _tagged(session: Session, name: str, hits: DataFrame) -> DataFrame:
    """(collection, key, video_id, label, score)."""
    return hits.select(F.lit(name).alias("collection"), F.col("key").cast("string").alias("key"), "video_id", session.collections[name].label().alias("label"), "score")


@CATALOGUE.add("kg")
def multi_granularity_search(session: Session, query: str, k: int = 5, video_ids: list[str] | None = None, least: float = 0.4) -> DataFrame:
    """Entities, events and events of frames together: the k nearest of each, as (collection, key, video_id, label, score)."""
    names = ("entities", "events", "micro_events")
    return reduce(DataFrame.unionByName, [_tagged(session, n, semantic(session, n, query, k, video_ids, least)) for n in names])


def bm25_hits(session: Session, name: str, query: str, video_ids: list[str] | None = None) -> DataFrame:
    """Rows of a collection that hold a term of the question, by the sum of their fields' BM25. Documents of the whole collection make the statistics; the scope comes after."""
    found, words = session.collections[name], S.analysed_query(query, session.stem)
    one = lambda f: session.indexes[name, f].scores(words[0]) if (name, f) in session.indexes else S.bm25(found.rows.select("key", F.coalesce(F.col(f), F.lit("")).alias(f)), words[0], "key", f, words[1])
    scored = [one(f) for f in found.fields]
    total = reduce(DataFrame.unionByName, scored).groupBy("key").agg(F.sum("score").alias("score"))
    return without_vectors(session.within(name, video_ids)).join(total, "key")


@CATALOGUE.add("kg")
def search_bm25(session: Session, query: str, collections: list[str] | None = None, k: int = 10, video_ids: list[str] | None = None, least: float = 0.1) -> DataFrame:
    """Words in the text of collections: the k best of each, then all by score. Names that are none are passed over; none left is an error."""
    names = [c for c in dict.fromkeys(collections or GRAPH) if c in GRAPH and c in session.collections]
    if not names:
        raise ValueError("no valid collection")
    hits = [_tagged(session, n, top(above(bm25_hits(session, n, query, video_ids), least), k, "key")) for n in names]
    return reduce(DataFrame.unionByName, hits).orderBy(F.col("score").desc(), "collection", "key")


def _graph_hits(session: Session, seeds: list[str], query: str, depth: int, hops: int = 2) -> DataFrame:
    """(node, score) of the `depth` entities nearest to the question among those 1 to `hops` steps from the seeds; distinct first, then the limit."""
    spark = session.edges.sparkSession
    start = spark.createDataFrame([(f"entities/{s}",) for s in seeds], "node string")
    near = G.reachable(session.edges.select("src", "dst"), start, hops).filter("hops > 0").select("node")
    rows = in_scope(session.collections["entities"].rows, user_id=session.user_id)
    points = rows.select(F.concat(F.lit("entities/"), F.col("key").cast("string")).alias("node"), "embedding")
    scored = points.join(near, "node").select("node", V.cosine(F.col("embedding"), V.literal(session.encode(query))).alias("score"))
    return top(scored, depth, "node")


@CATALOGUE.add("kg")
def triple_hybrid_search(session: Session, query: str, seeds: list[str] | None = None, collections: list[str] | None = None, k: int = 10, video_ids: list[str] | None = None, least: float = 0.4, depth: int = S.DEPTH, graph_candidates: bool = True) -> DataFrame:
    """Words, meaning and the graph around seed entities, fused by reciprocal ranks; an absent list counts as rank 101.

    Lists are taken for each collection, `depth` rows each. With `graph_candidates` the graph's entities are candidates of their own; else they raise those that the other lists found.
    Rows come as (collection, key, video_id, label, rrf_score).
    """
    names = [n for n in collections or ["entities"] if n in session.collections]
    node = lambda n, c="key": F.concat(F.lit(f"{n}/"), F.col(c).cast("string"))
    ranked: dict[str, DataFrame] = {}
    words = [S.ranked(bm25_hits(session, n, query, video_ids).select(node(n).alias("node"), "score"), "node", depth) for n in names]
    vectors = [S.ranked(semantic(session, n, query, depth, video_ids, least).select(node(n).alias("node"), "score"), "node", depth) for n in names]
    ranked["bm25"], ranked["vector"] = reduce(DataFrame.unionByName, words), reduce(DataFrame.unionByName, vectors)
    if seeds and session.edges is not None:
        graph = S.ranked(_graph_hits(session, seeds, query, depth), "node", depth)
        if not graph_candidates:
            graph = graph.join(ranked["bm25"].select("node").unionByName(ranked["vector"].select("node")).distinct(), "node", "left_semi")
        ranked["graph"] = graph
    missing = 0.0 if "graph" in ranked else 1.0 / (S.RRF_K + S.ABSENT_RANK)
    fused = S.reciprocal_ranks(ranked, "node", k).select("node", (F.col("rrf_score") + missing).alias("rrf_score"))
    rows = reduce(DataFrame.unionByName, [session.collections[n].rows.select(node(n).alias("node"), F.lit(n).alias("collection"), F.col("key").cast("string").alias("key"), "video_id", session.collections[n].label().alias("label")) for n in names])
    return rows.join(F.broadcast(fused), "node").drop("node").orderBy(F.col("rrf_score").desc(), "collection", "key")


@CATALOGUE.add("kg")
def traverse_from_entity(session: Session, entity: str, depth: int = 2, video_ids: list[str] | None = None) -> DataFrame:
    """Nodes up to `depth` steps from an entity, each once and breadth first, as (key, collection, video_id, label, edge_type, weight, path_length). Steps may pass through nodes beyond the scope."""
    found = G.traversal(session.edges, f"entities/{entity}", depth)
    rows = [session.within(n, video_ids).select(F.concat(F.lit(f"{n}/"), F.col("key").cast("string")).alias("node"), F.col("key").cast("string").alias("key"), F.lit(n).alias("collection"), "video_id", session.collections[n].label().alias("label")) for n in GRAPH if n in session.collections]
    return reduce(DataFrame.unionByName, rows).join(found, "node").drop("node")


@CATALOGUE.add("kg")
def retrieve_for_rag(session: Session, query: str, video_ids: list[str] | None = None, traversal: bool = True, depth: int = 1, seeds: list[str] | None = None, sections: dict[str, int] | None = None) -> DataFrame:
    """What a question needs as context: (section, rank, key, video_id, label, score), with the graph around the first three entities, each node of it once."""
    n = SECTIONS | (sections or {})
    entities = triple_hybrid_search(session, query, seeds, k=n["entities"], video_ids=video_ids).withColumnRenamed("rrf_score", "score")
    parts = [entities.select(F.lit("entities").alias("section"), "key", "video_id", "label", "score")]
    for name, least in (("events", 0.5), ("micro_events", 0.5), ("communities", 0.4)):
        if name in session.collections:
            parts.append(_tagged(session, name, semantic(session, name, query, n[name], video_ids, least)).select(F.lit(name).alias("section"), "key", "video_id", "label", "score"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.col("score").desc(), "key")))
    ranked = cut(ranked)  # a few rows, asked again for the seeds of the graph's section
    if traversal and session.edges is not None:
        first = [r["key"] for r in ranked.filter("section = 'entities' AND rank <= 3").orderBy("rank").select("key").collect()]
        around = [traverse_from_entity(session, e, depth, video_ids).withColumn("_seed", F.lit(k)) for k, e in enumerate(first)]
        if around:
            once = reduce(DataFrame.unionByName, around).groupBy("collection", "key").agg(F.min_by(F.struct("video_id", "label"), "_seed").alias("r"), F.min("_seed").alias("_seed"))
            order = Window.orderBy("_seed", "collection", "key")
            ranked = ranked.unionByName(once.select(F.lit("graph_context").alias("section"), "key", "r.video_id", "r.label", F.lit(None).cast("double").alias("score"), F.row_number().over(order).alias("rank")))
    return ranked.select("section", "rank", "key", "video_id", "label", "score")


def videos_hit(context: DataFrame) -> DataFrame:
    """(video_id, hits) over the ranked sections of a context; hits without a video count as `unknown`."""
    return context.filter("section <> 'graph_context'").groupBy(F.coalesce("video_id", F.lit("unknown")).alias("video_id")).agg(F.count(F.lit(1)).alias("hits"))


def context_text(context: DataFrame, query: str) -> DataFrame:
    """One row: a context as text for a prompt, a heading and its first rows for each section that has any."""
    lines = F.create_map(*[F.lit(x) for kv in LINES.items() for x in kv])
    place = F.create_map(*[F.lit(x) for kv in zip(LINES, range(len(LINES)), strict=True) for x in kv])
    title = F.create_map(*[F.lit(x) for kv in {"entities": "Entities", "events": "Events", "micro_events": "Micro-events", "communities": "Communities", "graph_context": "Graph Context"}.items() for x in kv])
    kept = context.filter(F.col("rank") <= F.element_at(lines, F.col("section")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda r: F.concat(F.lit("  - "), r["label"])), "\n")
    sections = kept.groupBy("section").agg(rows.alias("lines"))
    text = sections.select(F.element_at(place, F.col("section")).alias("p"), F.concat(F.lit("\n--- "), F.element_at(title, F.col("section")), F.lit(" ---\n"), "lines").alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "\n")
    return text.agg(F.concat(F.lit(f"=== Knowledge Graph Context ===\nQuery: {query}\n\n"), body).alias("context"))


def context_statistics(context: DataFrame) -> DataFrame:
    """One row: hits of each kind, videos with any, mean score."""
    counts = [F.count_if(F.col("section") == s).alias(f"total_{s}") for s in SECTIONS]
    own = F.when(F.col("section") != "graph_context", F.col("video_id"))
    return context.agg(*counts, F.countDistinct(own).alias("videos_represented"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"))


def media(session: Session, name: str, query: str, k: int, video_ids: list[str] | None, hybrid: bool, least: float | None = None, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Rows of a media collection by meaning, or by meaning and words with weighted reciprocal ranks."""
    if not hybrid:
        return semantic(session, name, query, k, video_ids, least)
    rows = session.within(name, video_ids)
    dense = S.ranked(rows.withColumn("score", V.cosine(F.col("embedding"), V.literal(session.encode(query)))).filter("score IS NOT NULL"), "key")
    postings = session.collections[name].sparse.join(rows.select("key"), "key", "left_semi")
    sparse = S.ranked(S.sparse_topk(postings, session.encode_sparse(query), S.DEPTH, "key", "weight"), "key")
    fused = S.reciprocal_ranks({"dense": dense, "sparse": sparse}, "key", k, absent=None, weights=dict(zip(("dense", "sparse"), weights, strict=True)))
    return top(without_vectors(rows).join(F.broadcast(fused.select("key", F.col("rrf_score").alias("score"))), "key"), k, "key")


@CATALOGUE.add("search")
def images_from_caption(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None, hybrid: bool = False) -> DataFrame:
    """Images by what their captions say."""
    return media(session, "image_captions", query, k, video_ids, hybrid)


@CATALOGUE.add("search")
def images_from_vision(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None) -> DataFrame:
    """Images by what they show."""
    return media(session, "images", query, k, video_ids, False)


@CATALOGUE.add("search")
def segments_from_event(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None, hybrid: bool = False) -> DataFrame:
    """Segments by the captions of their events."""
    return media(session, "segment_captions", query, k, video_ids, hybrid)


@CATALOGUE.add("search")
def segments_from_vision(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None) -> DataFrame:
    """Segments by what they show."""
    return media(session, "segments", query, k, video_ids, False)


@CATALOGUE.add("search")
def audio_dense(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None) -> DataFrame:
    """Speech by meaning."""
    return media(session, "audio_transcripts", query, k, video_ids, False)


@CATALOGUE.add("search")
def audio_hybrid(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None) -> DataFrame:
    """Speech by meaning and words."""
    return media(session, "audio_transcripts", query, k, video_ids, True)


@CATALOGUE.add("ocr")
def search_ocr(session: Session, query: str, k: int = 10, video_ids: list[str] | None = None, fuzzy: bool = True, require_match: bool = True) -> DataFrame:
    """Text of images, fuzzy by the length of its words; the cleaned text counts 1.5, and pieces of it are marked. Without `require_match` other rows of the scope pad the result at zero."""
    rows = session.within("ocr", video_ids)
    found = S.text_search(rows, query, {"cleaned_text": 1.5, "raw_text": 1.0}, k, "key", fuzzy, "cleaned_text")
    if require_match:
        return found
    rest = rows.select("key").join(found.select("key"), "key", "left_anti").select("key", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("highlights"))
    return top(found.unionByName(rest), k, "key")


@CATALOGUE.add("ocr")
def get_ocr_by_video(session: Session, video_id: str, limit: int = 1000) -> DataFrame:
    """All text rows of a video in frame order."""
    return S.text_of_video(session.collections["ocr"].rows, "video_id", video_id, "frame_index", limit, user_id=session.user_id)


# what stands around a hit, and what there is of a video


def _of_video(session: Session, name: str, video_id: str) -> DataFrame:
    return in_scope(session.collections[name].rows, video_id=video_id, user_id=session.user_id)


@CATALOGUE.add("utility")
def related_speech_of_segment(session: Session, video_id: str, start: float, end: float, window: float = 10.0) -> DataFrame:
    """Speech within some seconds of a segment; rows have start_sec and end_sec."""
    return without_vectors(temporal.around(_of_video(session, "audio_transcripts", video_id), start, end, window))


@CATALOGUE.add("utility")
def related_speech_of_image(session: Session, video_id: str, at: float, window: float = 10.0) -> DataFrame:
    """Speech within some seconds of an image."""
    return without_vectors(temporal.around(_of_video(session, "audio_transcripts", video_id), at, at, window))


@CATALOGUE.add("utility")
def adjacent_segments(session: Session, video_id: str, pivot_start: int, pivot_end: int, hop: int = 1, forward: bool = True, include_range: bool = True) -> DataFrame:
    """The segments after or before one, by frames (start_frame, end_frame)."""
    return without_vectors(temporal.neighbours(_of_video(session, "segment_captions", video_id), pivot_start, pivot_end, hop, forward, include_range, "key", "start_frame", "end_frame"))


@CATALOGUE.add("utility")
def adjacent_images(session: Session, video_id: str, frame_index: int, hop: int = 1, forward: bool = True, include_range: bool = True) -> DataFrame:
    """The images at or after a frame, or at or before it."""
    return without_vectors(temporal.neighbour_images(_of_video(session, "images", video_id), frame_index, hop, forward, include_range))


@CATALOGUE.add("video")
def list_user_videos(session: Session, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the user's videos in the order of their keys."""
    return page(in_scope(session.collections["videos"].rows, user_id=session.user_id), [F.col("key")], limit, offset)


@CATALOGUE.add("video")
def get_video_metadata(session: Session, video_id: str) -> DataFrame:
    """The row of a video; a video that isn't there is an error."""
    row = in_scope(session.collections["videos"].rows, key=video_id, user_id=session.user_id).limit(1)
    if row.isEmpty():
        raise KeyError(f"no video {video_id}")
    return row


@CATALOGUE.add("video")
def get_video_timeline(session: Session, video_id: str, granularity: str = "segment") -> DataFrame:
    """Segments in the order of their frames, shots with their numbers, or minutes with how many segments begin in them and the first one's caption."""
    if granularity == "shot":
        # one video may have very many shots, so none of it is numbered in a single task
        placed = numbered(_of_video(session, "shots", video_id).select("video_id", "start_frame", "end_frame"), ["start_frame", "end_frame"], "_n")
        return placed.select("video_id", (F.col("_n") + 1).alias("shot_number"), "start_frame", "end_frame").orderBy("shot_number")
    rows = _of_video(session, "segment_captions", video_id)
    if granularity == "minute":
        return temporal.minute_timeline(rows, "video_id", "start_sec", "caption", "key").orderBy("minute")
    if granularity != "segment":
        raise ValueError(f"no granularity {granularity}")
    return without_vectors(rows).orderBy("start_frame", "key")


def call(session: Session, name: str, **args) -> str:
    """Run a tool of the catalogue and keep its result; the handle hangs on the tool, all arguments and the session's scope."""
    rows = CATALOGUE.tools[name](session, **args)
    return session.results.put(name, args | {"_scope": [session.user_id, session.video_ids]}, rows)


def view_result(session: Session, handle: str, mode: str = "brief", n: int = 5, group_by: str = "video_id", brief: list[str] | None = None) -> DataFrame:
    """A kept result: `brief` or `detailed` (the n best), `statistics` of a column or of `score_bucket`, or `full`."""
    rows = session.results.get(handle)
    return S.statistics(rows, group_by, "key") if mode == "statistics" else S.view(rows, mode, n, "key", brief)
