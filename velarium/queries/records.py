"""Small operators over records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from velarium.functions import keys, text, timecode
from velarium.operators import chat, metrics, records, scope, store, temporal
from velarium.queries.base import Book

book = Book()


@book.query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 5)")
def payload_scroll(t):
    """A payload filter without the vectors."""
    return records.scrolled(t("embeddings"), 1_000_000, label=[1, 5])


@book.query("SELECT doc_id, lang, source FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 100")
def keyword_scan(t):
    """A page of rows whose keyword equals a value."""
    return records.keyword_page(t("documents"), "source", "src1", "doc_id", 100).select("doc_id", "lang", "source")


@book.query("SELECT count(*) AS total, array_to_string((SELECT list(n_name ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)), ',') AS first FROM nation")
def preview_first(t):
    """The number of rows and the first ten."""
    return records.preview(t("nation").select("n_nationkey", "n_name"), "n_nationkey").select("total", F.array_join("first.n_name", ",").alias("first"))


@book.query("SELECT c_custkey, c_name, c_nationkey * 10 AS tens FROM customer")
def document_projection(t):
    """Kept columns that are there, and a computed one."""
    return records.kept_columns(t("customer"), ["c_custkey", "c_name", "nothing"]).join(t("customer").select("c_custkey", (F.col("c_nationkey") * 10).alias("tens")), "c_custkey")


@book.query("SELECT doc_id::varchar AS id, n_chars::double AS size, coalesce(lang, 'und') AS lang, 0 AS missing FROM documents")
def typed_hits(t):
    """Required and optional columns with casts and defaults."""
    hits = t("documents").withColumnsRenamed({"doc_id": "id", "n_chars": "size"})
    return records.typed(hits, {"id": "string", "size": "double"}, {"lang": ("string", "und"), "missing": ("int", 0)})


@book.query("SELECT row_number() OVER (ORDER BY vec_id) AS rank, 0.5::double AS score, 'v' || label AS video_id, vec_id AS t0, vec_id + 2 AS t1, vec_id * 25 AS f0, 'seg ' || vec_id AS caption FROM embeddings")
def shown_segments(t):
    """Segments in the shape a client shows, taken apart again."""
    rows = metrics.numbered(t("embeddings").select("vec_id", "label"), ["vec_id"]).select((F.col("number") + 1).cast("long").alias("rank"), F.lit(0.5).alias("score"), F.concat(F.lit("v"), "label").alias("video_id"), F.col("vec_id").alias("start_time"), (F.col("vec_id") + 2).alias("end_time"), (F.col("vec_id") * 25).alias("frame_start"), (F.col("vec_id") * 25 + 50).alias("frame_end"), F.concat(F.lit("seg "), "vec_id").alias("caption"))
    return records.shown(rows, "segment").select("rank", "score", "video_id", F.col("time_start").alias("t0"), F.col("time_end").alias("t1"), F.col("frames.start").alias("f0"), "caption")


@book.query("SELECT page_id, lower(CASE WHEN page_id % 3 = 0 THEN 'VIDEO/MP4' ELSE 'text/html' END) = 'video/mp4' OR regexp_matches(CASE WHEN page_id % 5 = 0 THEN 'a.MKV' WHEN page_id % 7 = 0 THEN 'a.mkv' END, '\\.mkv$') IS TRUE AS valid FROM pages")
def upload_validation(t):
    """A type in any case or an ending as it is makes an upload valid."""
    mime = F.when(F.col("page_id") % 3 == 0, "VIDEO/MP4").otherwise("text/html")
    name = F.when(F.col("page_id") % 5 == 0, "a.MKV").when(F.col("page_id") % 7 == 0, "a.mkv")
    return t("pages").select("page_id", records.valid_upload(mime, name).alias("valid"))


@book.query("SELECT user_id, count(*) AS steps FROM events WHERE event_type <> 'error' GROUP BY user_id")
def named_tool_steps(t):
    """Steps with a name, of each user's array of steps."""
    steps = t("events").groupBy("user_id").agg(F.collect_list(F.struct(F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("name"), F.col("event_id").alias("id"))).alias("steps"))
    return steps.select("user_id", F.size(records.named_steps(F.col("steps"))).cast("long").alias("steps"))


@book.query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 4")
def messages_of_user(t):
    """Messages of a user's sessions with the sessions' names: orders of a nation's customers."""
    sessions = t("customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name"))
    messages = t("orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey")
    return records.messages_of_user(messages, sessions, 4).select("o_orderkey", F.col("session_name").alias("c_name"))


@book.query("SELECT vec_id AS doc_id, lang, n_chars FROM embeddings JOIN documents ON doc_id = vec_id WHERE label = 1")
def fused_fetch(t):
    """The rows of fused keys in one join."""
    return records.fetched(t("embeddings").filter("label = 1").select(F.col("vec_id").alias("doc_id")), t("documents"), "doc_id").select("doc_id", "lang", "n_chars")


@book.query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def first_of_each(t):
    """Of equal keys the first row in an order."""
    return records.first_of_each(t("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@book.query("SELECT role, text FROM conversations")
def agent_history(t):
    """Messages as an agent reads them."""
    rows = t("conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), F.current_timestamp().alias("timestamp"), "role", "text")
    return records.history(rows)


@book.query("SELECT conv_id, count(*) - 1 AS finished, arg_max(text, turn) AS in_progress FROM conversations GROUP BY conv_id")
def resumed_sessions(t):
    """Finished blocks and the text so far of the last."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    blocks = t("conversations").select("conv_id", F.col("turn").alias("n"), "text", (F.col("turn") < last).alias("finished"))
    return records.replayed(blocks, "conv_id").select("conv_id", (F.size("finished")).cast("long").alias("finished"), "in_progress")


@book.query("""SELECT '{"event":"' || event_type || '","event_id":' || event_id || ',"user_id":' || user_id || '}' AS json FROM events""")
def tagged_json(t):
    """Events as JSON with the name of their kind."""
    return records.tagged_json(t("events"), F.col("event_type"), "event_id", "user_id")


@book.query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'list' WHEN 2 THEN 'text' ELSE 'scalar' END AS kind FROM events")
def json_kinds(t):
    """What tool output holds."""
    out = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), "user_id", F.lit("]"))).when(F.col("event_id") % 4 == 2, F.lit("not {json")).otherwise(F.lit("12"))
    return t("events").select("event_id", records.json_kind(out).alias("kind"))


@book.query("SELECT count(*) AS vectors, sum(len(embedding))::bigint AS total_size, round(avg(len(embedding)), 3) AS mean_size FROM embeddings")
def embedding_sizes(t):
    """Totals of vectors' sizes."""
    return metrics.embedding_sizes(t("embeddings"), "embedding")


@book.query("SELECT 'documents' AS collection, count(*) AS points, 0::bigint AS indexed, 'yellow' AS status FROM documents UNION ALL SELECT 'embeddings', count(*), count(embedding), 'green' FROM embeddings")
def collection_stats(t):
    """Rows, indexed rows and status of collections."""
    return metrics.collection_stats({"documents": t("documents"), "embeddings": t("embeddings")})


@book.query("SELECT doc_id, quality * 100 + toxic * 50 AS status, quality * 100 + toxic * 50 >= 100 AS ingested FROM labels")
def ingested_flag(t):
    """A computed column of the status."""
    return store.ingested(t("labels").select("doc_id", (F.col("quality") * 100 + F.col("toxic") * 50).alias("status")))


@book.query("SELECT page_id AS video_id, url FROM pages WHERE page_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def retried_videos(t):
    """Wanted ids that are there, with their address."""
    return store.retried(t("pages").select(F.col("page_id").alias("video_id"), "url"), t("embeddings").filter("label = 3").select(F.col("vec_id").alias("video_id")))


@book.query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 200 AND i < 500")
def batch_of_range(t):
    """Rows of batches 2 to 4 of a hundred."""
    rows = metrics.numbered(t("events").select("event_id", "user_id"), ["event_id"], "i")
    return temporal.batch_of_range(rows, "i", 2, 4, 100).select("user_id", "event_id")


@book.query("""
    WITH r AS (SELECT n_nationkey AS rid, n_nationkey * 3 AS from_batch, n_nationkey * 3 + n_regionkey AS to_batch FROM nation), e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
    SELECT rid, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r JOIN e ON i >= from_batch * 50 AND i < (to_batch + 1) * 50 GROUP BY rid""")
def ranges_joined(t):
    """Ranges of batches with their rows, as an equi-join on the batch."""
    ranges = t("nation").select(F.col("n_nationkey").alias("rid"), (F.col("n_nationkey") * 3).cast("long").alias("from_batch"), (F.col("n_nationkey") * 3 + F.col("n_regionkey")).cast("long").alias("to_batch"))
    rows = metrics.numbered(t("events").select("event_id"), ["event_id"], "i")
    found = temporal.ranges_joined(ranges, rows, "i", 50)
    return found.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@book.query("""
    WITH c AS (SELECT user_id AS s, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 3) AS seconds, list(DISTINCT event_type) AS found FROM events GROUP BY user_id),
    r AS (SELECT c_custkey AS s, CASE WHEN c_nationkey % 3 = 0 THEN [] ELSE ['view', 'lost'] END AS wanted FROM customer)
    SELECT s AS session_id, coalesce(calls, 0) AS calls, coalesce(failed, 0) AS failed, coalesce(seconds, 0.0) AS seconds, len(wanted) > 0 AS has_expectations,
        CASE WHEN len(wanted) > 0 THEN round(list_contains(coalesce(found, []), 'view')::int / len(wanted), 4) END AS recall FROM r LEFT JOIN c USING (s)""")
def evaluation_traces(t):
    """Evaluation records with what their runs did, with and without expectations."""
    wanted = F.when(F.col("c_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("view"), F.lit("lost")))
    told = t("customer").select(F.col("c_custkey").alias("session_id"), wanted.alias("expected_video_ids"))
    calls = t("events").select(F.col("user_id").alias("session_id"), F.lit("tool").alias("tool"), F.array("event_type").alias("output_video_ids"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    return records.trace(told, calls)


@book.query("SELECT doc_id, round(n_chars / 25.0, 3) AS seconds, lpad((n_chars // 25 // 3600)::varchar, 2, '0') || ':' || lpad((n_chars // 25 // 60 % 60)::varchar, 2, '0') || ':' || lpad((n_chars // 25 % 60)::varchar, 2, '0') || '.' || lpad((n_chars % 25 * 40)::varchar, 3, '0') AS at FROM documents")
def frame_timestamps(t):
    """Timestamps of frames at 25 a second, and their seconds again."""
    at = timecode.frames_to_timestamp(F.col("n_chars"), F.lit(25.0))
    return t("documents").select("doc_id", F.round(timecode.time_to_seconds(at), 3).alias("seconds"), at.alias("at"))


@book.query("SELECT doc_id, n_chars AS frame, (n_chars * 40)::bigint AS ms FROM documents")
def timecode_frames(t):
    """Frames of timecodes, half to even, and milliseconds of the same."""
    at = timecode.seconds_to_timecode(F.col("n_chars") / 25.0)
    return t("documents").select("doc_id", timecode.timecode_to_frame(at, F.lit(25.0)).alias("frame"), F.round(timecode.time_to_seconds(at) * 1000).cast("long").alias("ms"))


@book.query("SELECT event_id, 'events::' || event_id AS key, printf('k_%04d', event_id) AS numbered FROM events")
def document_keys(t):
    """Scoped and numbered keys, with and without their collection."""
    plain = keys.strip_collection(F.concat(F.lit("events/"), F.col("event_id").cast("string")))
    return t("events").select("event_id", keys.scoped_key(F.lit("events"), plain).alias("key"), keys.numbered_key("k", F.col("event_id")).alias("numbered"))


@book.query(r"SELECT page_id, regexp_replace(lower(url), '[^a-z0-9-]', '-', 'g') AS slug, coalesce(nullif('', ''), nullif(url, ''), '') AS first FROM pages")
def slugs(t):
    """Slugs of addresses, and the first value that is not empty."""
    return t("pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.first_truthy(F.lit(""), F.lit(None).cast("string"), F.col("url")).alias("first"))


@book.query("""
    WITH u AS (SELECT c_custkey AS user_id, 'l' || c_custkey AS login_id, 'm' || c_custkey || '@x' AS email FROM customer WHERE c_acctbal > 0),
    l AS (SELECT DISTINCT 'l' || (c_custkey + 1) AS login_id, 'm' || c_custkey || '@x' AS email FROM customer),
    m AS (SELECT l.login_id, l.email, coalesce(a.user_id, b.user_id) AS user_id FROM l LEFT JOIN u a ON a.login_id = l.login_id LEFT JOIN u b ON b.email = l.email)
    SELECT login_id, email, user_id, user_id IS NULL AS is_new FROM m""")
def login_by_mail(t):
    """Logins by their id, else by their e-mail, else new."""
    users = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("l"), "c_custkey").alias("login_id"), F.concat(F.lit("m"), "c_custkey", F.lit("@x")).alias("email"))
    logins = t("customer").select(F.concat(F.lit("l"), F.col("c_custkey") + 1).alias("login_id"), F.concat(F.lit("m"), "c_custkey", F.lit("@x")).alias("email")).distinct()
    return store.matched_users(users, logins)


@book.query("SELECT conv_id, turn, CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet FROM (SELECT *, greatest(instr(lower(text), 'on') - 40, 1) AS a, least(instr(lower(text), 'on') + 1 + 40, length(text)) AS b FROM conversations WHERE instr(lower(text), 'on') > 0)")
def block_snippet_search(t):
    """Chat search over text blocks: the first block that holds the text."""
    blocks = F.array(F.struct(F.lit("#").alias("text")), F.struct(F.col("text").alias("text")), F.struct(F.lit("on and on").alias("text")))
    rows = t("conversations").withColumn("blocks", F.when(F.instr(F.lower("text"), "on") > 0, blocks).otherwise(F.slice(blocks, 1, 2)))
    return chat.block_search(rows, "on").select("conv_id", "turn", "snippet")


@book.query("SELECT event_id FROM events WHERE event_id < 50 ORDER BY event_id")
def ordered_by_time(t):
    """Rows by a time that is parsed."""
    rows = t("events").filter("event_id < 50").withColumn("at", timecode.seconds_to_timecode(F.col("event_id") * 1.5))
    return scope.page(records.by_time(rows, "at", parsed=True), [timecode.parse_time_safe(F.col("at"))], 50).select("event_id")


QUERIES, ORACLE_SQL = book.queries, book.sql
