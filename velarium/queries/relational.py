"""Scans, joins with defaults, mutations and roll-ups over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from velarium.functions import keys, text
from velarium.operators import metrics as M
from velarium.operators import scope, store
from velarium.operators.chat import sessions
from velarium.queries.base import Book
from velarium.sources.tables import by_json

book = Book()


@book.query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '3' OR event_id = 7")
def full_record_by_id(t):
    return by_json(t("events"), "props", "$.k", 3, None).select("event_id", "user_id").unionByName(t("events").filter("event_id = 7").select("event_id", "user_id")).distinct()


@book.query("SELECT event_id, (json_extract_string(props, '$.k'))::int AS k FROM events WHERE json_extract_string(props, '$.k')::int >= 5 AND event_type = 'view' AND user_id > 3")
def json_compound_filter(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").withColumn("k", k).filter((F.col("k") >= 5) & (F.col("event_type") == "view") & (F.col("user_id") > 3)).select("event_id", "k")


@book.query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def scoped_page(t):
    rows = scope.in_scope(t("documents"), lang=["de", "fr"], source="src3", doc_id=None)
    return scope.page(rows, [F.col("n_chars").desc(), F.col("doc_id")], 20, 5).select("doc_id", "lang", "n_chars")


@book.query("SELECT 'orders' AS \"table\", count(*) AS deleted, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 5)) AS kept FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) UNION ALL SELECT 'customer', count(*), (SELECT count(*) FROM customer WHERE c_nationkey <> 5) FROM customer WHERE c_nationkey = 5")
def cascade_delete_poststate(t):
    ids = t("customer").filter("c_nationkey = 5").select("c_custkey")
    left, gone = store.cascade({"orders": (t("orders"), "o_custkey"), "customer": (t("customer"), "c_custkey")}, ids)
    kept = lambda n: left[n].agg(F.count(F.lit(1)).alias("kept")).withColumn("table", F.lit(n))
    return gone["orders"].unionByName(gone["customer"]).join(kept("orders").unionByName(kept("customer")), "table").select("table", "deleted", "kept")


@book.query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_lineage(t):
    done = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(done, "l_orderkey", "left_semi").select("l_partkey", "l_suppkey")


@book.query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 2 = 1) WHERE n = 1 UNION ALL SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 2 = 0) WHERE n = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1)")
def upsert_latest(t):
    rows = t("events").select("user_id", "event_id", "event_type", "value")
    old = store.upsert(rows.limit(0), rows.filter("event_id % 2 = 0"), ["user_id"], "event_id")
    return store.upsert(old, rows.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@book.query("SELECT coalesce(l.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN l.toxic = 0 WHEN p.doc_id IS NOT NULL THEN true ELSE l.toxic = 1 END AS selected FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 2000) p ON l.doc_id = p.doc_id")
def toggle_upsert(t):
    old = t("labels").select("doc_id", (F.col("toxic") == 1).alias("selected"))
    return store.toggled(old, t("documents").filter("n_chars > 2000").select("doc_id"), ["doc_id"])


@book.query("SELECT d.doc_id, coalesce(max(quality), -1)::int AS quality, coalesce(max(toxic), 0)::int AS toxic FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.doc_id")
def left_join_default(t):
    return store.left_default(t("documents").select("doc_id"), t("labels"), ["doc_id"], {"quality": -1, "toxic": 0})


@book.query("SELECT count(*) FILTER (quality IS NOT NULL) AS with_value, count(*) FILTER (quality IS NULL) AS without_value, (SELECT array_to_string(list(doc_id ORDER BY doc_id), ',') FROM (SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id LIMIT 3)) AS sample FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_counts(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return M.coverage(rows, "quality", "doc_id").withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@book.query("SELECT event_type, round(sum(value), 2) AS sum_value, count(*) AS calls, array_to_string(list_sort(list_distinct(list(json_extract_string(props, '$.k')))), ',') AS kinds FROM events GROUP BY event_type")
def usage_rollup(t):
    return M.usage(t("events").withColumn("k", F.get_json_object("props", "$.k")), ["event_type"], ["value"], "k")


@book.query("SELECT coalesce(event_type, 'TOTAL') AS event_type, round(sum(value), 2) AS amount, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def cost_breakdown(t):
    return M.with_total(t("events"), "event_type", "value")


@book.query("""SELECT coalesce(tool, 'ALL') AS tool, count(*) FILTER (kind = 'started') AS calls, count(*) FILTER (kind = 'completed' AND value <= 40) AS succeeded, count(*) FILTER (kind = 'error' OR (kind = 'completed' AND value > 40)) AS failed
    FROM (SELECT 't' || user_id % 7 AS tool, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'completed' ELSE event_type END AS kind, value FROM events) GROUP BY ROLLUP (tool)""")
def tool_stats(t):
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "completed").otherwise(F.col("event_type"))
    rows = t("events").select(F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tool"), kind.alias("kind"), "value")
    return M.tool_calls(rows, "tool", "kind", F.col("value") > 40)


@book.query("SELECT event_id, started_at FROM (SELECT *, last(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, tool ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started_at FROM (SELECT *, event_id % 3 AS tool FROM events)) WHERE event_type = 'click'")
def tool_event_matching(t):
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "completed").otherwise("other")
    rows = t("events").select("user_id", (F.col("event_id") % 3).alias("tool"), "event_id", kind.alias("kind"))
    return M.completed_calls(rows, "user_id", "tool", "event_id", "kind").select("event_id", "started_at")


@book.query("SELECT o_custkey, round(least(avg((o_orderstatus = 'F')::int) * 100, 100), 2) AS percent, count(*) AS stages FROM orders GROUP BY o_custkey")
def progress_percentage(t):
    return M.progress(t("orders"), "o_custkey", F.col("o_orderstatus") == "F")


@book.query("SELECT conv_id, max(turn) AS last_updated, count(*) AS messages FROM conversations GROUP BY conv_id ORDER BY 2 DESC, 1 LIMIT 50")
def session_history(t):
    return sessions(t("conversations"), limit=50)


@book.query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list('p' || l_partkey))), ',') AS parents FROM lineitem GROUP BY l_orderkey")
def lineage_rows(t):
    made = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("parents"))
    edges = store.lineage_rows(made.withColumn("parents", F.array_append("parents", F.lit(""))), "l_orderkey", "parents")
    return edges.groupBy(F.col("child").alias("l_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("parent")), ",").alias("parents"))


@book.query("SELECT page_id, split_part(regexp_replace(url, '^[a-z0-9]+://[^/]*/', ''), '/', 1) AS bucket, regexp_replace(lower(url), '[^a-z0-9-]', '-', 'g') AS slug FROM pages")
def url_and_slug(t):
    return t("pages").select("page_id", keys.url_parts(F.col("url"))["bucket"].alias("bucket"), text.slug(F.col("url")).alias("slug"))


@book.query("SELECT c_custkey, 'v' || c_nationkey || '::' || printf('event_%04d', c_custkey) AS key, CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '...' ELSE c_name END AS label FROM customer")
def scoped_keys(t):
    key = keys.scoped_key(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")), keys.numbered_key("event", F.col("c_custkey")))
    return t("customer").select("c_custkey", key.alias("key"), text.truncated(text.first_truthy(F.col("c_name")), 10).alias("label"))


@book.query("SELECT s_suppkey AS login, c.c_custkey AS user_id, c.c_custkey IS NULL AS is_new FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey AND c.c_acctbal > 2000")
def login_matching(t):
    users = t("customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("login_id"), F.col("c_custkey").alias("user_id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("email"))
    logins = t("supplier").select(F.col("s_suppkey").alias("login_id"), F.lit("x").alias("email"))
    return store.matched_users(users, logins).select(F.col("login_id").alias("login"), "user_id", "is_new")


@book.query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    kept = t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE_SQL = book.queries, book.sql
