"""The knowledge graph's tools over the test tables: parts are entities, orders events, messages events of frames, nations communities, lines edges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from velarium.operators import graph as G
from velarium.operators import kgbuild as K
from velarium.operators import metrics as M
from velarium.operators import records as R
from velarium.operators import retrieval as T
from velarium.operators import search as S
from velarium.queries.base import Book
from velarium.queries.search import _COS, QUERY, _bm25_sql
from velarium.shared import own_dir

book = Book()

_N = "(SELECT count(*) FROM embeddings)"
#: The collections in SQL, and the edges between their nodes.
_VIEWS = f"""
    ent AS (SELECT p_partkey AS key, 'v' || p_size % 7 AS video_id, p_name AS name, p_brand AS descr, embedding FROM part JOIN embeddings ON vec_id = p_partkey % {_N}),
    ev AS (SELECT o_orderkey AS key, 'v' || o_custkey % 7 AS video_id, o_orderpriority AS caption, embedding FROM orders JOIN embeddings ON vec_id = o_orderkey % {_N}),
    mi AS (SELECT conv_id * 1000 + turn AS key, 'v' || conv_id % 7 AS video_id, text, embedding FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % {_N}),
    co AS (SELECT n_nationkey AS key, 'v' || n_nationkey % 7 AS video_id, n_name AS title, r_name AS summary, embedding FROM nation JOIN region ON r_regionkey = n_regionkey JOIN embeddings ON vec_id = n_nationkey % {_N}),
    ed AS (SELECT 'entities/' || l_partkey AS src, 'events/' || l_orderkey AS dst, l_returnflag AS edge_type, l_quantity AS weight FROM lineitem
        UNION ALL SELECT 'events/' || o_orderkey, 'communities/' || c_nationkey, 'IN', 1.0 FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _session(t, **options) -> T.Session:
    n = t("embeddings").agg(F.count(F.lit(1)).alias("n"))
    vectors = t("embeddings").select("vec_id", "embedding")

    def of(rows, key, video, number, **fields):
        cols = [F.expr(key).alias("key"), F.concat(F.lit("v"), F.expr(video) % 7).alias("video_id"), F.lit(None).cast("string").alias("user_id"), F.expr(number).alias("_no"), *[F.col(c).alias(a) for a, c in fields.items()]]
        return rows.select(*cols).join(F.broadcast(n)).withColumn("vec_id", F.col("_no") % F.col("n")).join(vectors, "vec_id").drop("vec_id", "_no", "n")

    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    collections = {
        "entities": T.Collection(of(t("part"), "p_partkey", "p_size", "p_partkey", name="p_name", descr="p_brand"), ("name", "descr")),
        "events": T.Collection(of(t("orders"), "o_orderkey", "o_custkey", "o_orderkey", caption="o_orderpriority"), ("caption",)),
        "micro_events": T.Collection(of(t("conversations"), "conv_id * 1000 + turn", "conv_id", "conv_id * 7 + turn", text="text"), ("text",)),
        "communities": T.Collection(of(nations, "n_nationkey", "n_nationkey", "n_nationkey", title="n_name", summary="r_name"), ("title", "summary")),
    }
    lines = t("lineitem").select(F.concat(F.lit("entities/"), "l_partkey").alias("src"), F.concat(F.lit("events/"), "l_orderkey").alias("dst"), F.col("l_returnflag").alias("edge_type"), F.col("l_quantity").alias("weight"))
    homes = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("events/"), "o_orderkey").alias("src"), F.concat(F.lit("communities/"), "c_nationkey").alias("dst"), F.lit("IN").alias("edge_type"), F.lit(1.0).alias("weight"))
    return T.Session(collections, lambda _: QUERY, lines.unionByName(homes), stem=False, **options)


def _near_sql(view: str, label: str, name: str, k: int, least: float, where: str = "true") -> str:
    return f"(SELECT '{name}' AS collection, key::varchar AS key, video_id, {label} AS label, {_COS} AS s FROM {view} WHERE {_COS} > {least} AND {where} ORDER BY s DESC, {view}.key LIMIT {k})"


@book.query(f"WITH {_VIEWS} SELECT key, video_id, name, round({_COS}, 6) AS score FROM ent WHERE video_id IN ('v1', 'v4') AND {_COS} > 0.1 ORDER BY {_COS} DESC, key LIMIT 10")
def kg_entities_semantic(t):
    """Entities by meaning, in the session's videos."""
    hits = T.search_entities_semantic(_session(t, video_ids=["v1", "v4"]), "question", 10, least=0.1)
    return hits.select("key", "video_id", "name", F.round("score", 6).alias("score"))


@book.query(f"WITH {_VIEWS} SELECT key, video_id, caption, round({_COS}, 6) AS score FROM ev WHERE video_id = 'v2' AND {_COS} > 0.1 ORDER BY {_COS} DESC, key LIMIT 10")
def kg_events_semantic(t):
    """Events by meaning; the argument's videos win over the session's."""
    return T.search_events(_session(t, video_ids=["v1"]), "question", 10, ["v2"], 0.1).select("key", "video_id", "caption", F.round("score", 6).alias("score"))


@book.query(f"WITH {_VIEWS} SELECT key, video_id, title, round({_COS}, 6) AS score FROM co WHERE {_COS} > 0.0 ORDER BY {_COS} DESC, key LIMIT 5")
def kg_communities_semantic(t):
    """Communities by meaning."""
    return T.search_communities(_session(t), "question", 5, least=0.0).select("key", "video_id", "title", F.round("score", 6).alias("score"))


@book.query(f"""WITH {_VIEWS} SELECT collection, key, video_id, label, round(s, 6) AS score FROM ({_near_sql('ent', 'name', 'entities', 5, 0.1)} UNION ALL {_near_sql('ev', 'caption', 'events', 5, 0.1)} UNION ALL {_near_sql('mi', 'text', 'micro_events', 5, 0.1)})""")
def kg_multi_granularity(t):
    """The nearest entities, events and events of frames by cosine."""
    return T.multi_granularity_search(_session(t), "question", 5, least=0.1).withColumn("score", F.round("score", 6))


_WORDS = "red widget brand nation 1"
_BM_ENT = f"(SELECT key, sum(score) AS s FROM ({_bm25_sql(_WORDS.split(), 'ent', 'key', 'name')} UNION ALL {_bm25_sql(_WORDS.split(), 'ent', 'key', 'descr')}) GROUP BY key)"
_BM_CO = f"(SELECT key, sum(score) AS s FROM ({_bm25_sql(_WORDS.split(), 'co', 'key', 'title')} UNION ALL {_bm25_sql(_WORDS.split(), 'co', 'key', 'summary')}) GROUP BY key)"


_BM_SQL = f"""WITH {_VIEWS} SELECT collection, key::varchar AS key, video_id, label, round(s, 6) AS score FROM (
    (SELECT 'entities' AS collection, key, video_id, name AS label, s FROM ent JOIN {_BM_ENT} USING (key) WHERE s > 0.1 ORDER BY s DESC, key LIMIT 10)
    UNION ALL (SELECT 'communities', key, video_id, title, s FROM co JOIN {_BM_CO} USING (key) WHERE s > 0.1 ORDER BY s DESC, key LIMIT 10))"""


@book.query(_BM_SQL)
def kg_bm25(t):
    """Words in the text of two collections; a name that is none is passed over."""
    return T.search_bm25(_session(t), _WORDS, ["entities", "communities", "nothing"], 10).withColumn("score", F.round("score", 6))


@book.query(_BM_SQL)
def kg_bm25_indexed(t):
    """The same from stored text indexes of the collections' fields."""
    session = _session(t)
    session.stem = False
    session.index_text(f"{own_dir(t('part').sparkSession)}/kg-{uuid.uuid4().hex}", ["entities", "communities"])
    return T.search_bm25(session, _WORDS, ["entities", "communities"], 10).withColumn("score", F.round("score", 6))


_BOTH = "(SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed)"
_HOPS = f"""
    h1 AS (SELECT DISTINCT dst AS node FROM {_BOTH} WHERE src IN ('entities/1', 'entities/2')),
    h2 AS (SELECT DISTINCT dst AS node FROM {_BOTH} WHERE src IN (SELECT node FROM h1)),
    nb AS (SELECT node FROM h1 UNION SELECT node FROM h2 WHERE node NOT IN ('entities/1', 'entities/2')),
    b AS (SELECT key, row_number() OVER (ORDER BY s DESC, 'entities/' || key) AS r FROM {_BM_ENT} ORDER BY r LIMIT 50),
    v AS (SELECT key, row_number() OVER (ORDER BY s DESC, 'entities/' || key) AS r FROM (SELECT key, s FROM (SELECT key, {_COS} AS s FROM ent) WHERE s > 0.1 ORDER BY s DESC, key LIMIT 50)),
    g AS (SELECT key, row_number() OVER (ORDER BY s DESC, node) AS r FROM (SELECT key, 'entities/' || key AS node, {_COS} AS s FROM ent WHERE 'entities/' || key IN (SELECT node FROM nb) AND 'entities/' || key NOT IN ('entities/1', 'entities/2')) ORDER BY r LIMIT 50)"""
_RRF = "coalesce(1.0 / (60 + b.r), 1.0 / 161) + coalesce(1.0 / (60 + v.r), 1.0 / 161) + coalesce(1.0 / (60 + g.r), 1.0 / 161)"


@book.query(f"""WITH {_VIEWS}, {_HOPS}, k AS (SELECT key FROM b UNION SELECT key FROM v UNION SELECT key FROM g)
    SELECT 'entities' AS collection, key::varchar AS key, video_id, name AS label, round(s, 9) AS rrf_score FROM (SELECT key, {_RRF} AS s FROM k LEFT JOIN b USING (key) LEFT JOIN v USING (key) LEFT JOIN g USING (key) ORDER BY s DESC, 'entities/' || key LIMIT 10) JOIN ent USING (key)""")
def kg_triple_hybrid(t):
    """Words, meaning and the graph around two seeds, whose neighbours are candidates of their own."""
    return T.triple_hybrid_search(_session(t), _WORDS, ["1", "2"], k=10, least=0.1).withColumn("rrf_score", F.round("rrf_score", 9))


@book.query(f"""WITH {_VIEWS}, {_HOPS}, k AS (SELECT key FROM b UNION SELECT key FROM v)
    SELECT 'entities' AS collection, key::varchar AS key, video_id, name AS label, round(s, 9) AS rrf_score FROM (SELECT key, {_RRF} AS s FROM k LEFT JOIN b USING (key) LEFT JOIN v USING (key) LEFT JOIN g USING (key) ORDER BY s DESC, 'entities/' || key LIMIT 10) JOIN ent USING (key)""")
def kg_triple_hybrid_boost(t):
    """As `kg_triple_hybrid`, the graph only raising what the other lists found."""
    return T.triple_hybrid_search(_session(t), _WORDS, ["1", "2"], k=10, least=0.1, graph_candidates=False).withColumn("rrf_score", F.round("rrf_score", 9))


@book.query(f"""WITH {_VIEWS}, e2 AS (SELECT src, dst, edge_type, weight FROM ed UNION ALL SELECT dst, src, edge_type, weight FROM ed),
    l1 AS (SELECT dst AS node, 2 AS path_length, arg_min({{'e': edge_type, 'w': weight}}, (edge_type, weight, src)) AS x FROM e2 WHERE src = 'entities/1' AND dst <> 'entities/1' GROUP BY dst),
    l2 AS (SELECT dst AS node, 3 AS path_length, arg_min({{'e': edge_type, 'w': weight}}, (edge_type, weight, src)) AS x FROM e2 WHERE src IN (SELECT node FROM l1) AND dst <> 'entities/1' AND dst NOT IN (SELECT node FROM l1) GROUP BY dst),
    n AS (SELECT 'entities' AS collection, key, video_id, name AS label FROM ent UNION ALL SELECT 'events', key, video_id, caption FROM ev UNION ALL SELECT 'communities', key, video_id, title FROM co)
    SELECT key::varchar AS key, collection, video_id, label, x.e AS edge_type, x.w AS weight, path_length FROM n JOIN (SELECT * FROM l1 UNION ALL SELECT * FROM l2) ON node = collection || '/' || key WHERE video_id IN ('v1', 'v2', 'v3')""")
def kg_traverse(t):
    """Two steps from an entity over typed edges, then the scope."""
    return T.traverse_from_entity(_session(t), "1", 2, ["v1", "v2", "v3"]).withColumn("path_length", F.col("path_length").cast("int"))


_RAG = f"""{_VIEWS},
    b AS (SELECT key, row_number() OVER (ORDER BY s DESC, 'entities/' || key) AS r FROM {_BM_ENT} ORDER BY r LIMIT 50),
    v AS (SELECT key, row_number() OVER (ORDER BY s DESC, 'entities/' || key) AS r FROM (SELECT key, s FROM (SELECT key, {_COS} AS s FROM ent) WHERE s > 0.4 ORDER BY s DESC, key LIMIT 50)),
    e10 AS (SELECT key, coalesce(1.0 / (60 + b.r), 1.0 / 161) + coalesce(1.0 / (60 + v.r), 1.0 / 161) + 1.0 / 161 AS s FROM b FULL JOIN v USING (key) ORDER BY s DESC, 'entities/' || key LIMIT 10),
    hits AS (SELECT 'entities' AS section, key::varchar AS key, video_id, name AS label, s FROM e10 JOIN ent USING (key)
        UNION ALL SELECT * FROM {_near_sql('ev', 'caption', 'events', 5, 0.5)} UNION ALL SELECT * FROM {_near_sql('mi', 'text', 'micro_events', 5, 0.5)} UNION ALL SELECT * FROM {_near_sql('co', 'title', 'communities', 3, 0.4)}),
    rk AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY s DESC, key) AS rank, key, video_id, label, s AS score FROM hits),
    e2 AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed),
    cx AS (SELECT dst, min(rank) AS seed FROM e2 JOIN rk ON section = 'entities' AND rank <= 3 AND src = 'entities/' || key AND dst <> src GROUP BY dst),
    n AS (SELECT 'entities' AS c, key, video_id, name AS label FROM ent UNION ALL SELECT 'events', key, video_id, caption FROM ev UNION ALL SELECT 'communities', key, video_id, title FROM co),
    gc AS (SELECT 'graph_context' AS section, row_number() OVER (ORDER BY seed, c, key::varchar) AS rank, key::varchar AS key, video_id, label, NULL::double AS score FROM cx JOIN n ON dst = c || '/' || key)"""


@book.query(f"WITH {_RAG} SELECT section, rank::int AS rank, key, video_id, label, round(score, 9) AS score FROM (SELECT * FROM rk UNION ALL SELECT * FROM gc)")
def kg_rag_context(t):
    """The sections of a question's context, and the graph around its first entities."""
    return T.retrieve_for_rag(_session(t), _WORDS).select("section", F.col("rank").cast("int").alias("rank"), "key", "video_id", "label", F.round("score", 9).alias("score"))


@book.query(f"WITH {_RAG} SELECT coalesce(video_id, 'unknown') AS video_id, count(*) AS hits FROM rk GROUP BY 1")
def kg_videos_hit(t):
    """Hits of each video in a context."""
    return T.videos_hit(T.retrieve_for_rag(_session(t), _WORDS, traversal=False))


@book.query(f"""WITH {_RAG} SELECT count(*) FILTER (section = 'entities') AS total_entities, count(*) FILTER (section = 'events') AS total_events, count(*) FILTER (section = 'micro_events') AS total_micro_events,
    count(*) FILTER (section = 'communities') AS total_communities, count(DISTINCT video_id) AS videos_represented, round(avg(score), 6) AS avg_score FROM rk""")
def kg_search_statistics(t):
    """Totals of a context."""
    return T.context_statistics(T.retrieve_for_rag(_session(t), _WORDS, traversal=False))


@book.query()
def kg_context_text(t):
    """A context as text for a prompt; the test holds it to the rows of `kg_rag_context`."""
    return T.context_text(T.retrieve_for_rag(_session(t), _WORDS), _WORDS)


@book.query()
def kg_bm25_analysed(t):
    """BM25 over terms without accents and stemmed; tested against a naive recomputation."""
    return S.bm25_topk(t("documents"), "Éauons running connections", 10, stem=True).select("doc_id", F.round("score", 6).alias("score"))


@book.query("""
    WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents),
    e AS (SELECT term, row_number() OVER (PARTITION BY q ORDER BY levenshtein(term, q), term) AS k FROM v, (VALUES ('thention', 2), ('ofand', 1)) x(q, n) WHERE term <> '' AND abs(length(term) - length(q)) <= n AND levenshtein(term, q) <= n),
    w AS (SELECT DISTINCT term FROM e WHERE k <= 50),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents),
    s AS (SELECT count(*)::double AS n, avg(len(ts)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d),
    f AS (SELECT doc_id, dl, term, count(*)::double AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL),
    g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f)
    SELECT doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM g, s GROUP BY doc_id
    ORDER BY sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) DESC, doc_id LIMIT 10""")
def fuzzy_text_search(t):
    """Fuzzy search of two words as one operator: expansion, BM25 and ranking."""
    return S.text_search(t("documents"), "thention ofand", {"text": 1.0}, 10, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@book.query()
def ocr_search(t):
    """Text of images: pages stand for them, the address as raw and the text as cleaned; the test holds the scores to `best_field` and the pieces to their text."""
    ocr = t("pages").select(F.col("page_id").alias("key"), F.lit("v1").alias("video_id"), F.lit(None).cast("string").alias("user_id"), F.col("page_id").alias("frame_index"), F.col("html").alias("cleaned_text"), F.col("url").alias("raw_text"))
    session = T.Session({"ocr": T.Collection(ocr, ("cleaned_text", "raw_text"))}, lambda _: QUERY)
    return T.search_ocr(session, "titel org", 10).select("key", F.round("score", 6).alias("score"), "highlights")


@book.query("SELECT page_id AS key, url, 0.0::double AS score FROM pages WHERE split_part(url, ':', 1) = 'https' ORDER BY page_id LIMIT 1000")
def ocr_of_video(t):
    """All text rows of a video in frame order."""
    rows = t("pages").select(F.col("page_id").alias("key"), "url", F.split_part("url", F.lit(":"), F.lit(1)).alias("video_id"))
    return S.text_of_video(rows, "video_id", "https", "key").select("key", "url", "score")


@book.query(f"SELECT vec_id AS key, label::varchar AS video_id, round({_COS}, 6) AS score FROM embeddings WHERE label = 2 ORDER BY {_COS} DESC, vec_id LIMIT 5")
def media_visual(t):
    """Images by what they show, through a handle and its brief view."""
    rows = t("embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("video_id"), F.lit(None).cast("string").alias("user_id"), "embedding")
    session = T.Session({"images": T.Collection(rows, ())}, lambda _: QUERY, video_ids=["2"])
    handle = T.call(session, "search.images_from_vision", query="question", k=20)
    return T.view_result(session, handle, "brief", 5, brief=["key", "video_id", "score"]).withColumn("score", F.round("score", 6))


_HYBRID_SQL = f"""
    WITH d AS (SELECT vec_id AS key, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, {_COS} AS s FROM embeddings) ORDER BY r LIMIT 50),
    p AS (SELECT doc_id AS key, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
    w AS (SELECT key, sum(CASE term WHEN 'the' THEN 0.5 WHEN 'and' THEN 1.5 ELSE 2.0 END) AS s FROM p WHERE term IN ('the', 'and', 'der') GROUP BY key),
    x AS (SELECT key, row_number() OVER (ORDER BY s DESC, key) AS r FROM w ORDER BY r LIMIT 50)
    SELECT key, round(coalesce(0.7 / (60 + d.r), 0) + coalesce(0.3 / (60 + x.r), 0), 9) AS score FROM d FULL JOIN x USING (key) ORDER BY coalesce(0.7 / (60 + d.r), 0) + coalesce(0.3 / (60 + x.r), 0) DESC, key LIMIT 10"""


@book.query(_HYBRID_SQL)
def media_hybrid(t):
    """Speech by meaning and words: weighted reciprocal ranks of a dense and a sparse list."""
    from velarium.functions import text

    rows = t("embeddings").select(F.col("vec_id").alias("key"), F.lit("v").alias("video_id"), F.lit(None).cast("string").alias("user_id"), "embedding")
    postings = S.sparse_postings(t("documents"), "doc_id", text.terms(F.col("text"))).select(F.col("doc_id").alias("key"), "term", F.col("tf").alias("weight"))
    session = T.Session({"audio_transcripts": T.Collection(rows, (), postings)}, lambda _: QUERY, encode_sparse=lambda _: {"the": 0.5, "and": 1.5, "der": 2.0})
    return T.audio_hybrid(session, "question", 10).select("key", F.round("score", 9).alias("score"))


_MEDIA = {"images_from_caption": "image_captions", "segments_from_vision": "segments"}


@book.query(" UNION ALL ".join(f"(SELECT '{tool}' AS tool, vec_id AS key, round({_COS}, 6) AS score FROM embeddings WHERE label = {n + 1} ORDER BY {_COS} DESC, vec_id LIMIT 7)" for n, tool in enumerate(_MEDIA)))
def media_dense(t):
    """Images by what their captions say and segments by what they show, each in a video of its own."""
    rows = t("embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("video_id"), F.lit(None).cast("string").alias("user_id"), "embedding")
    session = T.Session({c: T.Collection(rows, ()) for c in _MEDIA.values()}, lambda _: QUERY)
    found = [T.CATALOGUE.tools[f"search.{tool}"](session, "question", 7, [str(n + 1)]).select(F.lit(tool).alias("tool"), "key", F.round("score", 6).alias("score")) for n, tool in enumerate(_MEDIA)]
    return found[0].unionByName(found[1])


@book.query(_HYBRID_SQL)
def media_events_hybrid(t):
    """Segments by the captions of their events, by meaning and words."""
    from velarium.functions import text

    rows = t("embeddings").select(F.col("vec_id").alias("key"), F.lit("v").alias("video_id"), F.lit(None).cast("string").alias("user_id"), "embedding")
    postings = S.sparse_postings(t("documents"), "doc_id", text.terms(F.col("text"))).select(F.col("doc_id").alias("key"), "term", F.col("tf").alias("weight"))
    session = T.Session({"segment_captions": T.Collection(rows, (), postings)}, lambda _: QUERY, encode_sparse=lambda _: {"the": 0.5, "and": 1.5, "der": 2.0})
    return T.segments_from_event(session, "question", 10, hybrid=True).select("key", F.round("score", 9).alias("score"))


def _video(t):
    """Orders' lines as segments, images, speech and shots of their customer's video."""
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")
    begin = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    base = lines.select(key, F.concat(F.lit("v"), F.col("o_custkey") % 5).alias("video_id"), F.lit("u").alias("user_id"), begin.alias("start_frame"), (begin + F.col("l_linenumber")).alias("end_frame"), (begin / 4.0).alias("start_sec"), (begin / 4.0 + F.col("l_linenumber")).alias("end_sec"), begin.alias("frame_index"), F.col("o_orderpriority").alias("caption"))
    videos = t("customer").select(F.concat(F.lit("v"), "c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") < 13, "u").otherwise("w").alias("user_id"))
    return T.Session({**{n: T.Collection(base, ("caption",)) for n in ("segment_captions", "audio_transcripts", "images", "shots")}, "videos": T.Collection(videos, ("name",))}, lambda _: QUERY, user_id="u")


_SEG = "seg AS (SELECT l_orderkey * 10 + l_linenumber AS key, 'v' || o_custkey % 5 AS video_id, l_orderkey * 100 + l_linenumber * 10 AS f0, l_orderkey * 100 + l_linenumber * 11 AS f1, (l_orderkey * 100 + l_linenumber * 10) / 4.0 AS s0, l_linenumber AS n, o_orderpriority AS caption FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@book.query(f"""WITH {_SEG}
    SELECT 'speech' AS tool, key, s0::double AS at FROM seg WHERE video_id = 'v2' AND s0 <= 5020 + 30 AND s0 + n >= 5000 - 30
    UNION ALL SELECT 'image speech', key, s0::double FROM seg WHERE video_id = 'v1' AND s0 <= 7000 + 50 AND s0 + n >= 7000 - 50
    UNION ALL (SELECT 'segments', key, f0::double FROM seg WHERE video_id = 'v3' AND f0 >= 20000 ORDER BY f0, key LIMIT 4)
    UNION ALL (SELECT 'images', key, f0::double FROM (SELECT *, row_number() OVER (ORDER BY f0 DESC, key) AS r FROM seg WHERE video_id = 'v3' AND f0 <= 30000) WHERE r = 3)""")
def media_context_tools(t):
    """Speech around a segment and an image, and neighbours of a segment and an image, by the tools of the catalogue."""
    session = _video(t)
    of = lambda name, rows, at: rows.select(F.lit(name).alias("tool"), "key", F.col(at).cast("double").alias("at"))
    found = of("speech", T.related_speech_of_segment(session, "v2", 5000.0, 5020.0, 30.0), "start_sec").unionByName(of("image speech", T.related_speech_of_image(session, "v1", 7000.0, 50.0), "start_sec"))
    found = found.unionByName(of("segments", T.adjacent_segments(session, "v3", 19_990, 20_000, 4), "start_frame"))
    return found.unionByName(of("images", T.adjacent_images(session, "v3", 30_000, 3, False, False), "frame_index"))


@book.query(f"""WITH {_SEG}
    SELECT 'shot' AS tool, row_number() OVER (ORDER BY f0, f1) AS n, f0::varchar AS label FROM seg WHERE video_id = 'v4'
    UNION ALL SELECT 'minute', floor(s0 / 60)::bigint, arg_min(caption, (s0, key)) || count(*) FROM seg WHERE video_id = 'v4' GROUP BY floor(s0 / 60)::bigint
    UNION ALL SELECT 'segment', key, caption FROM seg WHERE video_id = 'v4'
    UNION ALL (SELECT 'videos', c_custkey, c_name FROM customer WHERE c_nationkey < 13 ORDER BY 'v' || c_custkey LIMIT 7 OFFSET 3)""")
def media_video_tools(t):
    """Timelines of a video by shot, minute and segment, and a page of the user's videos, by the tools of the catalogue."""
    session = _video(t)
    of = lambda name, rows, n, label: rows.select(F.lit(name).alias("tool"), n.cast("long").alias("n"), label.cast("string").alias("label"))
    found = of("shot", T.get_video_timeline(session, "v4", "shot"), F.col("shot_number"), F.col("start_frame"))
    found = found.unionByName(of("minute", T.get_video_timeline(session, "v4", "minute"), F.col("minute"), F.concat("caption", F.col("n").cast("string"))))
    found = found.unionByName(of("segment", T.get_video_timeline(session, "v4"), F.col("key"), F.col("caption")))
    return found.unionByName(of("videos", T.list_user_videos(session, 7, 3), F.substring("key", 2, 20), F.col("name")))


@book.query()
def tool_catalogue(t):
    """The catalogue of tools: name, signature, first line of the documentation."""
    return t("region").sparkSession.createDataFrame(T.CATALOGUE.describe(), "name string, signature string, about string")


# building the graph


@book.query("""
    WITH r AS (SELECT o_orderkey % 50 AS segment, 'p' || l_partkey % 20 AS subject, 'c' || o_custkey % 20 AS object FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT DISTINCT o_orderkey % 50 AS segment, 'p' || l_partkey % 20 AS local_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 25),
    v AS (SELECT DISTINCT o_orderkey % 50 AS segment, 'c' || o_custkey % 20 AS local_id FROM orders WHERE o_totalprice > 200000 UNION SELECT DISTINCT o_orderkey % 50, 'p' || l_partkey % 20 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40),
    i AS (SELECT segment, local_id, 'entity_' || substr(sha256(concat_ws(':', segment, local_id)), 1, 16) AS id, 0 AS p FROM e UNION ALL SELECT segment, local_id, 'event_' || substr(sha256(concat_ws(':', segment, local_id)), 1, 16), 1 FROM v),
    m AS (SELECT segment, local_id, arg_min(id, p) AS id FROM i GROUP BY ALL)
    SELECT r.segment, coalesce(s.id, r.subject) AS subject, coalesce(o.id, r.object) AS object, count(*) AS n FROM r LEFT JOIN m s ON s.segment = r.segment AND s.local_id = r.subject LEFT JOIN m o ON o.segment = r.segment AND o.local_id = r.object GROUP BY ALL""")
def kg_global_ids(t):
    """Ends local to a segment become global ids: an entity's first, else an event's, else as they are."""
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 50).alias("segment"), F.concat(F.lit("c"), F.col("o_custkey") % 20).alias("object"), "o_totalprice")
    rows = t("lineitem").join(o, "l_orderkey").withColumn("subject", F.concat(F.lit("p"), F.col("l_partkey") % 20))
    entities = rows.filter("l_quantity > 25").select("segment", F.col("subject").alias("local_id"))
    events = o.filter("o_totalprice > 200000").select("segment", F.col("object").alias("local_id")).unionByName(rows.filter("l_quantity > 40").select("segment", F.col("subject").alias("local_id")))
    out = K.remapped(rows.select("segment", "subject", "object"), entities, events)
    return out.groupBy("segment", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


@book.query("""
    SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(0.9 * list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 0.1 * (a.vec_id % 3 = b.vec_id % 3)::int, 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE 0.9 * list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 0.1 * (a.vec_id % 3 = b.vec_id % 3)::int >= 0.35""")
def kg_hybrid_similarity(t):
    """Pairs of a group by 0.9 of the dense and 0.1 of the sparse cosine."""
    points = t("embeddings").withColumn("sparse", F.array(F.struct((F.col("vec_id") % 3).cast("int").alias("term"), F.lit(2.0).alias("weight"))))
    return G.similar_pairs(points, "label", "vec_id", "embedding", 0.35, "sparse", block=20).withColumn("similarity", F.round("similarity", 6))


@book.query()
def kg_resolved_entities(t):
    """Average-linkage clusters by the hybrid similarity; tested against one matrix a group."""
    points = t("embeddings").withColumn("sparse", F.array(F.struct((F.col("vec_id") % 3).cast("int").alias("term"), F.lit(2.0).alias("weight"))))
    return G.resolved_entities(points, "label", "vec_id", "embedding", 0.35, "sparse")


@book.query("""
    WITH c AS (SELECT p_brand AS cluster, p_partkey AS local_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS descr FROM part)
    SELECT cluster, local_id, CASE WHEN n = 1 THEN name ELSE longest END AS canonical_name, CASE WHEN n = 1 THEN descr ELSE coalesce(texts, '') END AS merged_desc
    FROM c JOIN (SELECT cluster, count(*) AS n, arg_max(name, (length(name), name)) AS longest, string_agg(descr, ' ' ORDER BY local_id) FILTER (descr <> '') AS texts FROM c GROUP BY cluster) USING (cluster)""")
def kg_cluster_resolution(t):
    """Clusters without a model's groups are one entity each; proposals, failures and leftovers have unit tests."""
    rows = t("part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("local_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("desc"))
    return K.resolution(rows).select("cluster", "local_id", "canonical_name", "merged_desc")


def _parts(t):
    """The pieces of the graphs to walk on: parts, orders as events, lines as frame-level events."""
    lines = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("m"), "l_orderkey", F.lit("_"), "l_linenumber").alias("m"), "l_quantity", "l_suppkey", "l_returnflag", "l_discount")
    kind = F.when(F.col("l_returnflag") == "R", "NEXT_EVENT").when(F.col("l_returnflag") == "A", "SHARES_CONTEXT").otherwise("OTHER")
    return {
        "relations": lines.select(F.col("p").alias("src"), F.concat(F.lit("p"), "l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")),
        "micro_members": lines.select(F.col("p").alias("src"), F.col("m").alias("dst")),
        "micro_edges": lines.select(F.col("m").alias("src"), F.concat(F.substring_index("m", "_", 1), F.lit("_1")).alias("dst"), F.lit("CAUSAL_MICRO").alias("edge_type"), F.col("l_discount").alias("similarity")),
        "parents": lines.select(F.col("m").alias("src"), F.col("o").alias("dst")),
        "event_members": lines.select(F.col("o").alias("src"), F.col("p").alias("dst")),
        "event_edges": lines.select(F.col("o").alias("src"), F.col("p").alias("dst"), kind.alias("edge_type"), F.lit(None).cast("double").alias("similarity")),
        "members": lines.select(F.col("p").alias("src"), F.concat(F.lit("c"), F.col("l_suppkey") % 5).alias("dst")),
        "event_communities": lines.select(F.col("o").alias("src"), F.concat(F.lit("c"), F.col("l_suppkey") % 5).alias("dst"), (F.col("l_quantity") / 10).alias("shared")),
    }


def _nodes(t):
    lines = t("lineitem")
    cols = [F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("m"), "l_orderkey", F.lit("_"), "l_linenumber"), F.concat(F.lit("c"), F.col("l_suppkey") % 5)]
    return lines.select(F.explode(F.array(*cols)).alias("node")).distinct()


_GRAPH = """
    l AS (SELECT 'p' || l_partkey AS p, 'o' || l_orderkey AS o, 'm' || l_orderkey || '_' || l_linenumber AS m, 'p' || l_suppkey AS q, 'c' || l_suppkey % 5 AS c, * FROM lineitem),
    nd AS (SELECT p AS node FROM l UNION SELECT o FROM l UNION SELECT m FROM l UNION SELECT c FROM l),
    st AS (SELECT 0 AS k, p AS src, q AS dst, l_quantity AS w FROM l UNION ALL SELECT 1, p, m, 1.0 FROM l UNION ALL SELECT 2, m, 'm' || l_orderkey || '_1', 1.8 * l_discount FROM l UNION ALL SELECT 3, m, o, 1.5 FROM l
        UNION ALL SELECT 4, o, p, 1.0 FROM l UNION ALL SELECT 5, o, p, CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'A' THEN 1.2 ELSE 1.0 END FROM l UNION ALL SELECT 6, p, c, 1.0 FROM l UNION ALL SELECT 7, o, c, greatest(1.0, l_quantity / 10) FROM l),
    g AS (SELECT k, least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN k = 0 THEN sum(w) ELSE max(w) END AS w FROM st WHERE src <> dst AND src IN (SELECT node FROM nd) AND dst IN (SELECT node FROM nd) GROUP BY k, 2, 3)"""


@book.query(f"WITH {_GRAPH} SELECT a, b, round(w, 6) AS weight FROM g WHERE k = 0")
def kg_graph_a(t):
    """Entities and their summed relations."""
    nodes = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("node")).distinct()
    return K.entity_graph(nodes, _parts(t)["relations"]).withColumn("weight", F.round("weight", 6))


@book.query(f"WITH {_GRAPH} SELECT a, b, round(arg_max(w, k), 6) AS weight FROM g WHERE k <= 3 AND a NOT LIKE 'c%' AND b NOT LIKE 'c%' GROUP BY a, b")
def kg_graph_b(t):
    """Entities, events of frames and their events; a pair is in one piece only, as the pieces join different kinds of nodes."""
    return K.micro_graph(_nodes(t).filter("node NOT LIKE 'c%'"), _parts(t)).withColumn("weight", F.round("weight", 6))


@book.query(f"WITH {_GRAPH} SELECT a, b, round(CASE WHEN max(k) IN (4, 5) THEN max(w) ELSE arg_max(w, k) END, 6) AS weight FROM g GROUP BY a, b")
def kg_graph_c(t):
    """All pieces laid over each other; only members and typed edges of events meet on one pair here."""
    return K.full_graph(_nodes(t), _parts(t)).withColumn("weight", F.round("weight", 6))


@book.query(f"WITH {_GRAPH}, x AS (SELECT * FROM g WHERE k = 0), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT a AS node FROM x UNION SELECT b FROM x)) SELECT p.i AS a, q.i AS b, round(w, 6) AS weight FROM x JOIN n p ON p.node = a JOIN n q ON q.node = b")
def kg_relabelled(t):
    """Graph A with nodes as numbers in the order of their names."""
    return K.relabelled(kg_graph_a(t))[0]


@book.query("""
    WITH n AS (SELECT 'p' || p_partkey AS node, CASE p_size % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'event' WHEN 2 THEN 'micro_event' ELSE 'community' END AS node_type, p_partkey % (SELECT count(*) FROM embeddings) AS v FROM part)
    SELECT node, node_type, CASE WHEN node_type = 'entity' THEN round(e.embedding[1], 6) END AS a, CASE WHEN node_type <> 'community' THEN round(e.embedding[2], 6) END AS b, round(e.embedding[3], 6) AS c FROM n LEFT JOIN embeddings e ON vec_id = v""")
def kg_assembled_embeddings(t):
    """Nodes with their vectors in the three graphs, as far as their kind has one."""
    n = t("embeddings").agg(F.count(F.lit(1)).alias("n"))
    kind = F.element_at(F.array(F.lit("entity"), F.lit("event"), F.lit("micro_event"), F.lit("community")), (F.col("p_size") % 4 + 1).cast("int"))
    nodes = t("part").join(F.broadcast(n)).select(F.concat(F.lit("p"), "p_partkey").alias("node"), kind.alias("node_type"), (F.col("p_partkey") % F.col("n")).alias("vec_id"))
    vectors = nodes.join(t("embeddings"), "vec_id").select("node", F.col("embedding").alias("vector"))
    out = K.assembled(nodes.drop("vec_id"), vectors, vectors, vectors)
    return out.select("node", "node_type", *[F.round(F.get(c, F.lit(k)).cast("double"), 6).alias(a) for k, (c, a) in enumerate((("entity_only", "a"), ("entity_event", "b"), ("full", "c")))])


@book.query("SELECT p_partkey AS key, p_name AS name, round(embedding[1]::double + embedding[64]::double, 5) AS x FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def kg_attached(t):
    """Nodes with their vectors by key; those without one stay."""
    vectors = t("embeddings").select(F.col("vec_id").alias("key"), "embedding")
    out = K.attached(t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), vectors)
    return out.select("key", "name", F.round(F.get("embedding", F.lit(0)).cast("double") + F.get("embedding", F.lit(63)).cast("double"), 5).alias("x"))


@book.query("SELECT l_orderkey AS src, unnest(list_distinct(list(l_partkey))) AS dst FROM lineitem GROUP BY l_orderkey")
def kg_event_entities(t):
    """Edges of events to their entities."""
    events = t("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list("l_partkey").alias("entities"))
    return K.event_entities(events)


@book.query("SELECT n_regionkey AS community, count(*) AS size, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS members FROM nation GROUP BY 1")
def kg_community_sizes(t):
    """Sizes and members of communities."""
    out = M.community_sizes(t("nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community")))
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@book.query("""
    WITH n AS (SELECT n_regionkey AS community, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS r FROM nation)
    SELECT community, 'Community of ' || first(n_name ORDER BY r) AS title, count(*) || ' members, among them ' || string_agg(n_name, ', ' ORDER BY r) FILTER (r <= 5) AS summary, count(*) AS size FROM n GROUP BY community""")
def kg_community_texts(t):
    """Titles and summaries by the stand-in for a model."""
    members = t("nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return K.community_texts(members, t("nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")))


@book.query()
def modular_communities(t):
    """Leiden communities of the whole graph of parts and suppliers; the tests hold modularity to sequential runs and each community to being connected."""
    from velarium.operators.communities import leiden
    from velarium.queries.graph import _edges

    return leiden(G.simplified(_edges(t)))


@book.query()
def biased_walks(t):
    """Second-order walks with p = 0.5 and q = 2 over the whole weighted graph of parts and suppliers; each step is an edge (tested)."""
    from velarium.queries.graph import _edges

    return G.walks(_edges(t), 3, 10, weighted=True, p=0.5, q=2.0)


@book.query("""
    WITH v AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS edge_type FROM lineitem)
    SELECT 'entities' AS collection, count(*) AS inserted FROM v UNION ALL SELECT 'relations', count(*) FROM e UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM v) + (SELECT count(*) FROM e)""")
def kg_graph_load(t):
    """Two collections loaded twice: edges are keyed, so the second load adds nothing. Rows given to each and in all."""
    from velarium.operators import store

    new = {
        "entities": t("lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        "relations": t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("edge_type")),
    }
    state, _ = store.graph_load({}, new)
    again, counts = store.graph_load(state, new)
    held = again["relations"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("relations").alias("collection"), "n")
    return counts.join(held, "collection", "left").filter("n IS NULL OR n = inserted").select("collection", "inserted")


@book.query("""
    SELECT event_id, CASE WHEN n % 7 IN (0, 1) THEN 'document' WHEN n % 7 = 2 THEN 'microphone' WHEN n % 7 = 3 THEN 'photo' WHEN n % 7 = 4 THEN 'eye' WHEN n % 7 = 5 THEN 'magnifier' ELSE 'chip' END AS icon
    FROM (SELECT event_id, user_id AS n FROM events)""")
def tool_icons(t):
    """The icon of a tool by the first part that its name holds; users stand for tools' names."""
    names = ["OCR", "Search by Text  Recognition", "Voice Recognition of speech", "CLIP Search", "Image  Analysis", "kg-search", "Image\tRecogn-ition"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 7 + 1).cast("int"))
    return t("events").select("event_id", R.icon(name).alias("icon"))


def _typed(t):
    """Parts as entities, orders as events, nations as communities, of seven videos; lines and orders as edges between them."""
    video = lambda c: F.concat(F.lit("v"), (F.col(c) % 7).cast("string")).alias("video_id")
    key = lambda c: F.col(c).cast("string")
    nations = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return {
        "entities": t("part").select(key("p_partkey").alias("key"), video("p_size"), "p_name"),
        "events": t("orders").select(key("o_orderkey").alias("key"), video("o_custkey"), "o_orderpriority"),
        "communities": t("nation").select(key("n_nationkey").alias("key"), video("n_nationkey"), "n_name"),
        "event_entities": t("lineitem").select(key("l_orderkey").alias("src"), key("l_partkey").alias("dst"), F.col("l_returnflag").alias("edge_type")),
        "event_communities": nations.select(key("o_orderkey").alias("src"), key("c_nationkey").alias("dst"), F.lit("IN").alias("edge_type")),
    }


_TYPED = """
    ent AS (SELECT p_partkey AS key, p_size % 7 AS video FROM part), evt AS (SELECT o_orderkey AS key, o_custkey % 7 AS video FROM orders), com AS (SELECT n_nationkey AS key, n_nationkey % 7 AS video FROM nation),
    ee AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, l_returnflag AS edge_type FROM lineitem), ec AS (SELECT DISTINCT o_orderkey AS src, c_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey)"""


@book.query(f"""
    WITH {_TYPED}
    SELECT 'entities' AS collection, count(*) AS deleted FROM ent WHERE video IN (1, 4) UNION ALL SELECT 'events', count(*) FROM evt WHERE video IN (1, 4) UNION ALL SELECT 'communities', count(*) FROM com WHERE video IN (1, 4)
    UNION ALL SELECT 'event_entities', count(*) FROM ee WHERE src IN (SELECT key FROM evt WHERE video IN (1, 4)) OR dst IN (SELECT key FROM ent WHERE video IN (1, 4))
    UNION ALL SELECT 'event_communities', count(*) FROM ec WHERE src IN (SELECT key FROM evt WHERE video IN (1, 4)) OR dst IN (SELECT key FROM com WHERE video IN (1, 4))""")
def kg_store_deleted(t):
    """A graph loaded twice into a stored, checked state, then two videos deleted: the rows that each collection lost."""
    from velarium.operators.graphstore import GraphStore

    spark = t("part").sparkSession
    store, rows = GraphStore(spark, f"{own_dir(spark)}/graph-{uuid.uuid4().hex}"), _typed(t)
    store.load(rows)
    store.load({n: rows[n] for n in ("event_entities", "event_communities")})
    return store.delete_videos(spark.createDataFrame([("v1",), ("v4",)], "video_id string"))


@book.query(f"""
    WITH {_TYPED}
    SELECT 'event_entities' AS collection, 'dst' AS side, dst::varchar AS missing, count(*) AS edges FROM ee WHERE dst IN (SELECT key FROM ent WHERE video = 2) GROUP BY dst
    UNION ALL SELECT 'event_communities', 'dst', dst::varchar, count(*) FROM ec WHERE dst IN (SELECT key FROM com WHERE video = 2) GROUP BY dst""")
def kg_wrong_edges(t):
    """Edges that a graph without one video's vertices of two collections would leave without an end, by definition and end."""
    from velarium.operators import graphstore as GS

    rows = _typed(t) | {n: _typed(t)[n].filter("video_id <> 'v2'") for n in ("entities", "communities")}
    return GS.wrong_edges(GS.loaded({}, rows)).groupBy("collection", "side", "missing").agg(F.count(F.lit(1)).alias("edges"))


@book.query("""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.turn, coalesce(b.turn::varchar || ',' || length(b.text), '') AS vector FROM a LEFT JOIN b ON b.conv_id = a.conv_id AND b.i = a.i""")
def ordinal_answers(t):
    """Every turn with a vector of the answer at the same place of its conversation, an empty one where there are fewer answers."""
    turns = t("conversations").select("conv_id", "turn")
    answers = t("conversations").filter("role = 'assistant'").select("conv_id", "turn", F.array(F.col("turn").cast("long"), F.length("text").cast("long")).alias("vector"))
    return R.ordinal_join(turns, answers, "vector", ["conv_id"], ["turn"]).withColumn("vector", F.array_join(F.col("vector").cast("array<string>"), ","))


QUERIES, ORACLE_SQL = book.queries, book.sql
