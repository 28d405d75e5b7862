"""Vector, text and fused search over `embeddings`, `documents`, `pages` and `benchmark`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velarium.functions import keys, text
from velarium.functions import vector as V
from velarium.operators import search as S
from velarium.operators.chat import media_by_video, message_search
from velarium.plans.models import fan_out, hashed_encoder, with_vectors
from velarium.queries.base import Book
from velarium.shared import own_dir

book = Book()

#: A unit query vector of 64 components, by a rule, for Spark and for SQL.
QUERY = [((k * 37 + 11) % 17 - 8) / 8.0 for k in range(64)]
_Q = "[" + ",".join(repr(q) for q in QUERY) + "]::double[]"
_COS = f"list_cosine_similarity(embedding::double[], {_Q})"
WORDS = "the and der"


def _bm25_sql(words: list[str] | str, table: str = "documents", key: str = "doc_id", field: str = "text") -> str:
    inside = words if isinstance(words, str) else ",".join(f"'{w}'" for w in words)
    # parts add up in the order of their terms, as in `search.bm25`: else equal texts differ in the last digit, and their order hangs on chance
    return f"""
        SELECT {key}, list_reduce(list(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY term), lambda x, y: x + y) AS score
        FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (
                SELECT {key}, term, count(*)::double AS tf FROM (SELECT {key}, unnest(regexp_split_to_array(lower({field}), '[^a-z0-9]+')) AS term FROM {table})
                WHERE term IN ({inside}) GROUP BY ALL))
        JOIN (SELECT {key}, len(list_filter(regexp_split_to_array(lower({field}), '[^a-z0-9]+'), lambda t: t <> ''))::double AS dl FROM {table}) USING ({key}),
             (SELECT count(*)::double AS n, avg(len(list_filter(regexp_split_to_array(lower({field}), '[^a-z0-9]+'), lambda t: t <> ''))) AS avgdl FROM {table})
        GROUP BY {key}"""


@book.query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 2, 3) AND {_COS} > 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def dense_topk_filtered(t):
    return S.dense_topk(t("embeddings"), QUERY, 10, least=0.05, label=[1, 2, 3]).select("vec_id", "label", F.round("score", 6).alias("score"))


@book.query(f"SELECT label, vec_id, round(s, 6) AS score, rank FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT *, {_COS} AS s FROM embeddings)) WHERE rank <= 5")
def dense_topk_per_label(t):
    return S.dense_topk_by_group(t("embeddings"), QUERY, "label", 5).select("label", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@book.query("""
    SELECT doc_id, round(sum(tf * CASE term WHEN 'the' THEN 0.5 WHEN 'and' THEN 1.5 ELSE 2.0 END), 6) AS score
    FROM (SELECT doc_id, term, count(*)::double AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE term IN ('the', 'and', 'der') GROUP BY ALL)
    GROUP BY doc_id ORDER BY 2 DESC, doc_id LIMIT 10""")
def sparse_dot_topk(t):
    postings = S.sparse_postings(t("documents"), "doc_id", text.terms(F.col("text")))
    return S.sparse_topk(postings, {"the": 0.5, "and": 1.5, "der": 2.0}, 10).select("doc_id", F.round("score", 6).alias("score"))


@book.query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(WORDS.split())}) ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(t):
    return S.bm25_topk(t("documents"), WORDS, 10).select("doc_id", F.round("score", 6).alias("score"))


@book.query(f"SELECT page_id, round(max(score), 6) AS score FROM (SELECT page_id, 1.5 * score AS score FROM ({_bm25_sql(['title', 'org'], 'pages', 'page_id', 'url')}) UNION ALL SELECT page_id, score FROM ({_bm25_sql(['title', 'org'], 'pages', 'page_id', 'html')})) GROUP BY page_id ORDER BY max(score) DESC, page_id LIMIT 10")
def bm25_multi_field(t):
    return S.best_field(t("pages"), "title org", {"url": 1.5, "html": 1.0}, 10, "page_id").select("page_id", F.round("score", 6).alias("score"))


def _near_sql(words: list[tuple[str, int]]) -> str:
    """(term, edits): the nearest terms of the vocabulary of each word and its allowed edits."""
    values = ", ".join(f"('{w}', {n})" for w, n in words)
    return f"""(
        WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents),
        e AS (SELECT term, q, levenshtein(term, q) AS edits FROM v, (VALUES {values}) x(q, n) WHERE term <> '' AND abs(length(term) - length(q)) <= n AND levenshtein(term, q) <= n),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY edits, term) AS k FROM e)
        SELECT term, min(edits)::int AS edits FROM r WHERE k <= 50 GROUP BY term)"""


@book.query(f"SELECT * FROM {_near_sql([('thention', 2), ('ofand', 1)])}")
def bm25_fuzzy_terms(t):
    return S.fuzzy_terms(t("documents"), "thention ofand")


@book.query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql("SELECT term FROM " + _near_sql([("thention", 2)]))}) ORDER BY score DESC, doc_id LIMIT 10")
def bm25_fuzzy(t):
    """Fuzzy expansion and scores of its terms."""
    return S.bm25_fuzzy(t("documents"), "thention", 10).select("doc_id", F.round("score", 6).alias("score"))


def _index(t, *parts):
    """A stored index of the documents: all at once, or the parts one after the other and merged."""
    from velarium.operators.textindex import TextIndex

    docs = t("documents")
    index = TextIndex(docs.sparkSession, f"{own_dir(docs.sparkSession)}/text-{uuid.uuid4().hex}")
    for part in parts or (F.lit(True),):
        index.add(docs.filter(part), "doc_id", "text")
    return index


_QUESTIONS = (WORDS, "tion ing the", "nothing0 of")


@book.query(" UNION ALL ".join(f"SELECT {n} AS question, doc_id, round(score, 6) AS score FROM (SELECT * FROM ({_bm25_sql(q.split())}) ORDER BY score DESC, doc_id LIMIT 10)" for n, q in enumerate(_QUESTIONS)))
def indexed_bm25(t):
    """Three questions to one stored index, the ten best of each by bounds of blocks."""
    index = _index(t)
    best = [index.best(S.query_words(q), 10).select(F.lit(n).alias("question"), F.col("key").alias("doc_id"), F.round("score", 6).alias("score")) for n, q in enumerate(_QUESTIONS)]
    return reduce(DataFrame.unionByName, best)


@book.query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(WORDS.split())})")
def indexed_bm25_merged(t):
    """Scores of all documents from an index that got English documents, then the others, and was merged."""
    index = _index(t, F.col("lang") == "en", F.col("lang") != "en")
    index.merge()
    return index.scores(S.query_words(WORDS)).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@book.query(f"SELECT * FROM {_near_sql([('thention', 2), ('ofand', 1), ('in', 0)])}")
def indexed_fuzzy_terms(t):
    """Near terms by what is left of words when letters go, from two segments; the vocabulary isn't scanned."""
    return _index(t, F.col("lang") == "en", F.col("lang") != "en").near_terms(S.query_words("thention ofand in"))


_RANKS = f"""
    b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25_sql(WORDS.split())}) ORDER BY score DESC, doc_id LIMIT 50),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, {_COS} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 50)"""


def _points(t):
    return t("embeddings").withColumnRenamed("vec_id", "doc_id")


@book.query(f"WITH {_RANKS} SELECT doc_id, round(coalesce(1.0 / (60 + b.r), 1.0 / 161) + coalesce(1.0 / (60 + v.r), 1.0 / 161), 9) AS rrf_score FROM b FULL JOIN v USING (doc_id) ORDER BY coalesce(1.0 / (60 + b.r), 1.0 / 161) + coalesce(1.0 / (60 + v.r), 1.0 / 161) DESC, doc_id LIMIT 10")
def hybrid_search_rrf(t):
    return S.hybrid(t("documents"), _points(t), WORDS, QUERY, 10).select("doc_id", F.round("rrf_score", 9).alias("rrf_score"))


@book.query(f"WITH {_RANKS} SELECT doc_id, round(coalesce(0.3 / (60 + b.r), 0) + coalesce(0.7 / (60 + v.r), 0), 9) AS rrf_score FROM b FULL JOIN v USING (doc_id) ORDER BY coalesce(0.3 / (60 + b.r), 0) + coalesce(0.7 / (60 + v.r), 0) DESC, doc_id LIMIT 10")
def weighted_rrf(t):
    lists = {"text": S.ranked(S.bm25(t("documents"), S.query_words(WORDS)), "doc_id"), "vector": S.ranked(_points(t).withColumn("score", V.cosine(F.col("embedding"), V.literal(QUERY))), "doc_id")}
    return S.reciprocal_ranks(lists, "doc_id", 10, absent=None, weights={"text": 0.3, "vector": 0.7}).select("doc_id", F.round("rrf_score", 9).alias("rrf_score"))


@book.query(f"""WITH {_RANKS}, g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM (SELECT DISTINCT vec_id AS doc_id FROM embeddings WHERE label = 3) ORDER BY doc_id LIMIT 50),
    k AS (SELECT doc_id FROM b UNION SELECT doc_id FROM v UNION SELECT doc_id FROM g)
    SELECT doc_id, round(s, 9) AS rrf_score FROM (SELECT doc_id, coalesce(1.0 / (60 + b.r), 1.0 / 161) + coalesce(1.0 / (60 + v.r), 1.0 / 161) + coalesce(1.0 / (60 + g.r), 1.0 / 161) AS s
    FROM k LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN g USING (doc_id)) ORDER BY s DESC, doc_id LIMIT 10""")
def triple_hybrid_rrf(t):
    graph = _points(t).filter("label = 3").select("doc_id").distinct().orderBy("doc_id").limit(50)
    graph = graph.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("rank"))
    return S.hybrid(t("documents"), _points(t), WORDS, QUERY, 10, extra=graph).select("doc_id", F.round("rrf_score", 9).alias("rrf_score"))


@book.query("""
    WITH u AS (SELECT 'documents' AS collection, doc_id AS key, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
    s AS (SELECT collection, key, length(text) AS size FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY size DESC, key) AS rank FROM s)
    SELECT collection, key, size::bigint AS size, rank FROM r WHERE rank <= 5""")
def multi_collection_union(t):
    one = lambda name, key, field: t(name).select(F.lit(name).alias("collection"), F.col(key).alias("key"), F.length(field).cast("long").alias("size"))
    every = one("documents", "doc_id", "text").unionByName(one("pages", "page_id", "html")).unionByName(one("benchmark", "item_id", "text"))
    w = Window.partitionBy("collection").orderBy(F.col("size").desc(), "key")
    return every.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5")


@book.query(f"SELECT CAST(label AS VARCHAR) AS \"group\", count(*) AS n, round(avg(s), 3) AS mean_score, first(vec_id ORDER BY s DESC, vec_id) AS best_key FROM (SELECT *, {_COS} AS s FROM embeddings) GROUP BY label")
def result_stats_by_label(t):
    return S.statistics(t("embeddings").withColumn("score", V.cosine(F.col("embedding"), V.literal(QUERY))), "label")


@book.query(f"""SELECT printf('%.1f-%.1f', trunc(s * 10) / 10 + 0.0, trunc(s * 10) / 10 + 0.1) AS "group", count(*) AS n, round(avg(s), 3) AS mean_score, first(vec_id ORDER BY s DESC, vec_id) AS best_key
    FROM (SELECT vec_id, abs({_COS}) AS s FROM embeddings) GROUP BY 1""")
def result_stats_by_bucket(t):
    return S.statistics(t("embeddings").withColumn("score", F.abs(V.cosine(F.col("embedding"), V.literal(QUERY)))), "score_bucket")


@book.query(f"SELECT round(min(s), 6) AS min_score, round(max(s), 6) AS max_score, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.75), 6) AS p75 FROM (SELECT {_COS} AS s FROM embeddings)")
def score_percentiles(t):
    from velarium.operators.metrics import percentiles

    return percentiles(t("embeddings").select(V.cosine(F.col("embedding"), V.literal(QUERY)).alias("score")), "score")


@book.query("""
    SELECT conv_id, turn, CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet
    FROM (SELECT *, greatest(instr(lower(text), 'the') - 40, 1) AS a, least(instr(lower(text), 'the') + 2 + 40, length(text)) AS b FROM conversations WHERE instr(lower(text), 'the') > 0)""")
def chat_snippet_search(t):
    return message_search(t("conversations"), "the").select("conv_id", "turn", "snippet")


@book.query("SELECT doc_id, substr(md5(array_to_string(list_sort([lang, source, doc_id::varchar]), '|')), 1, 12) AS key FROM documents")
def cache_key_md5(t):
    return t("documents").select("doc_id", keys.cache_key(F.col("lang"), F.col("source"), F.col("doc_id")).alias("key"))


@book.query(r"SELECT doc_id, regexp_replace(text, '(and|the)', '<mark>\1</mark>', 'gi') AS marked FROM documents")
def highlight_terms_whole(t):
    """Every occurrence of two words between marks."""
    return t("documents").select("doc_id", text.highlight(F.col("text"), ["the", "and"]).alias("marked"))


@book.query("SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS grams FROM (SELECT doc_id, string_split(lower(text), '') AS c FROM documents)")
def trigram_counts_whole(t):
    """Distinct character trigrams of each document."""
    return t("documents").select("doc_id", F.size(F.array_distinct(text.ngrams(F.lower("text"), 3))).cast("long").alias("grams"))


@book.query(r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '([\p{L}\p{N}_]+)-\s+([\p{L}\p{N}_]+)', '\1\2', 'g'), '\s{2,}', ' ', 'g')) AS cleaned FROM documents""")
def ocr_clean_whole(t):
    """Cleaned text of all documents; tested against brute force too."""
    return t("documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@book.query()
def highlight_fragments(t):
    """Fragments of 200 characters; see the unit tests."""
    return t("documents").select("doc_id", text.fragments(F.col("text"), ["the"], 200, 3).alias("fragments"))


@book.query()
def ocr_clean_nfc(t):
    """Cleaning after normal form C, which SQL lacks."""
    return t("documents").select("doc_id", text.clean_text(text.nfc(F.col("text"))).alias("cleaned"))


@book.query()
def stemmed_terms(t):
    """Distinct stems of each document; the stemmer has unit tests."""
    return t("documents").select("doc_id", F.size(F.array_distinct(text.stems(text.terms(F.col("text"))))).alias("stems"))


@book.query("SELECT label, len(list(vec_id)) AS n, array_to_string(list(vec_id ORDER BY vec_id), ',') AS items FROM embeddings GROUP BY label")
def media_grouping(t):
    hits = media_by_video(t("embeddings"), "label", "vec_id", ["vec_id"])
    return hits.select("label", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["vec_id"].cast("string")), ",").alias("items"))


@book.query()
def model_slot_search(t):
    """Text encoded by the stand-in encoder and searched by variants of a question."""
    points = with_vectors(t("benchmark"), "text", hashed_encoder(64))

    def search(q):
        vector = points.sparkSession.range(1).select(hashed_encoder(64)(F.lit(q)).alias("v")).first()["v"]
        return S.dense_topk(points, list(vector), 10, "item_id")

    return fan_out(["the and of", "der die und"], search, "item_id").select("item_id", F.round("score", 6).alias("score"))


@book.query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_cells_full_probe(t):
    """k-means cells with every cell probed are exact."""
    return S.cells_topk(t("embeddings"), QUERY, 10, probes=8, cells=8).select("vec_id", F.round("score", 6).alias("score"))


@book.query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_index_exact(t):
    """The nearest vectors from a stored index, by cells in order of the least angle that they may hold."""
    return _vector_index(t).search(QUERY, 10).select("vec_id", F.round("score", 6).alias("score"))


@book.query("SELECT true AS reached")
def vector_index_recall(t):
    """Whether the cells that `probes_for` asks for give a recall at 10 of 0.9 over 20 queries, each held against a scan."""
    points, index = t("embeddings"), _vector_index(t)
    asked = [list(r["embedding"]) for r in points.orderBy(F.xxhash64("vec_id")).limit(20).collect()]
    probes = index.probes_for(asked, 10, 0.9)
    one = lambda rows, n: rows.select(F.lit(n).alias("q"), "vec_id")
    found = reduce(DataFrame.unionByName, [one(index.search(q, 10, probes=probes), n) for n, q in enumerate(asked)])
    exact = S.nearest_of_each(points.select("vec_id", "embedding"), asked, 10).select("q", "vec_id")
    return exact.join(found.withColumn("hit", F.lit(1)), ["q", "vec_id"], "left").agg((F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("reached"))


def _vector_index(t):
    points = t("embeddings")
    return S.VectorIndex(points.sparkSession, f"{own_dir(points.sparkSession)}/vectors-{uuid.uuid4().hex}").build(points)


QUERIES, ORACLE_SQL = book.queries, book.sql
