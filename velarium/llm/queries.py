"""The corpus operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.llm import bpe, collocations, crf_langid, decontaminate, dual_tree, exact_dedup, gru_lm, license_scan, line_dedup, quality_rules, secret_forest, sharding, simhash
from velarium.llm.text_rules import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gru_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op3_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = crf_langid.predict(docs, crf_langid.train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_rules.score(docs.select("doc_id", "text"), rules)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op12_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster_report(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_gru_lm_scores, op2_license_scan, op3_crf_language_id, op4_decontamination, op5_simhash_near_dedup, op6_sharding, op7_secret_scan, op8_quality_rules, op9_bpe, op10_exact_dedup,
    op11_line_dedup, op12_dual_tree_clusters, op13_collocations,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}


def _dual_tree_sql(rounds: int = 3) -> str:
    """Lloyd's rounds as a chain of common table expressions."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c FROM (SELECT c, sha256('1:' || vec_id) AS h FROM v ORDER BY h, c LIMIT 16))",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.c, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (SELECT v.vec_id, v.c AS v, c.k, {far} AS d FROM v, c{r} AS c) GROUP BY vec_id, v)")
        if r < rounds:
            parts = f"SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i"
            means = f"SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({parts}) GROUP BY k"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN ({means}) AS m USING (k))")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
        FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        WINDOW g AS (PARTITION BY h)
    """,
    "op11_line_dedup": r"""
        WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        repeated AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT doc_id, line, i, top IS NOT NULL AND doc_id <> top AS lost FROM keyed LEFT JOIN repeated USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_dual_tree_clusters": _dual_tree_sql(),
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m))
        ),
        counts AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
        cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) AS c
            JOIN counts AS l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ')
            JOIN counts AS r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, k + 1, c.m), ' ')
        ),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        spans AS (SELECT lang, f, w, size, unnest(range(1, m - size + 2)) AS i FROM candidates, (VALUES (2), (3)) AS inner_sizes(size) WHERE size < m),
        covers AS (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, max(f) AS f FROM spans GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM scored LEFT JOIN covers USING (lang, phrase) JOIN totals USING (lang)
        WHERE covers.f IS NULL OR 100 * covers.f < 80 * a
        QUALIFY rank <= 2000
    """,
}
