"""Timed rows over `events`: user_id stands for a video, [ts, ts + value s] for an interval."""

from __future__ import annotations

from pyspark.sql import functions as F

from velarium.functions import timecode as C
from velarium.operators import temporal as T
from velarium.queries.base import Book

book = Book()
_SEC = "epoch_us(ts) / 1000000.0"
_IV = f"(SELECT event_id, user_id, event_type, {_SEC} AS s, {_SEC} + value AS e FROM events)"


def _intervals(t):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return t("events").select("event_id", "user_id", "event_type", "value", sec.alias("start_sec"), (sec + F.col("value")).alias("end_sec"))


@book.query(f"""
    SELECT a.event_id AS event_id, b.event_id AS other FROM {_IV} a JOIN {_IV} b ON a.user_id = b.user_id AND a.event_id <> b.event_id
    WHERE least(a.e, b.e) > greatest(a.s, b.s) OR (b.s >= a.s AND b.e <= a.e) OR (a.s >= b.s AND a.e <= b.e)""")
def interval_overlap_context(t):
    rows = _intervals(t)
    return T.overlap_join(rows, rows, "user_id", 3600.0).filter("event_id <> r_event_id").select("event_id", F.col("r_event_id").alias("other"))


@book.query("SELECT user_id, event_id AS src, dst, round(greatest(ns - e, 0), 3) AS gap FROM (SELECT *, lead(event_id) OVER w AS dst, lead(s) OVER w AS ns FROM " + _IV + " WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) WHERE dst IS NOT NULL")
def next_event_edges(t):
    return T.next_edges(_intervals(t), "user_id", ["start_sec", "event_id"], "start_sec", "end_sec", "event_id").withColumn("gap", F.round("gap", 3))


@book.query("""
    WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (event_type = 'error')::int AS cut FROM events),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY i) AS run, min(CASE WHEN cut = 1 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc FROM f),
    s AS (SELECT user_id, min(i) AS first, max(coalesce(nc, i)) AS last FROM r WHERE cut = 0 GROUP BY user_id, run
          UNION ALL SELECT user_id, min(i), max(i) FROM f GROUP BY user_id HAVING min(cut) = 1)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first)::int AS shot, first::int AS first, last::int AS last FROM s""")
def shot_islands(t):
    from pyspark.sql import Window

    frames = t("events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"), (F.col("event_type") == "error").alias("cut"))
    return T.shots(frames, "user_id", "i", F.col("cut"))


@book.query("""
    WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, value, k, 0 AS g, CASE WHEN value >= 500 THEN 0.0 ELSE value END AS s, value >= 500 AS closed FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.event_id, o.value, o.k, w.g + w.closed::int, CASE WHEN w.s + o.value >= 500 THEN 0.0 ELSE w.s + o.value END, w.s + o.value >= 500 FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
    SELECT user_id, g::int AS segment, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def duration_segments(t):
    grouped = T.resetting_groups(t("events"), "user_id", ["ts", "event_id"], "value", 500.0, ["event_id"])
    return grouped.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@book.query("SELECT user_id, floor(s / 60)::bigint AS minute, count(*) AS n, first(event_type ORDER BY s, event_id) AS caption FROM " + _IV + " GROUP BY ALL")
def minute_timeline(t):
    return T.minute_timeline(_intervals(t), "user_id", "start_sec", "event_type", "event_id")


_SIDE = "(SELECT event_id AS key, floor(s)::bigint AS start, floor(e)::bigint AS fin FROM " + _IV + " WHERE user_id = (SELECT min(user_id) FROM events))"


def _pivot(t):
    rows = _intervals(t)
    first = rows.agg(F.min("user_id").alias("u"))
    mine = rows.join(F.broadcast(first), F.col("user_id") == F.col("u"))
    return mine.select(F.col("event_id").alias("key"), F.floor("start_sec").alias("start"), F.floor("end_sec").alias("end"))


@book.query(f"WITH r AS {_SIDE}, p AS (SELECT median(start)::bigint AS m FROM r) SELECT key, start, row_number() OVER (ORDER BY start, key)::int AS rank FROM r, p WHERE start >= m ORDER BY start, key LIMIT 3")
def adjacent_k(t):
    rows = _pivot(t).join(F.broadcast(_pivot(t).agg(F.bround(F.median("start"), 0).cast("long").alias("m"))))
    return T.neighbours(rows, F.col("m"), F.col("m"), 3).select("key", "start", "rank")


@book.query(f"WITH r AS {_SIDE}, p AS (SELECT median(start)::bigint AS m FROM r), o AS (SELECT key, start, row_number() OVER (ORDER BY fin DESC, key)::int AS rank FROM r, p WHERE fin <= m ORDER BY fin DESC, key LIMIT 2) SELECT * FROM o WHERE rank = (SELECT CASE WHEN count(*) < 2 THEN 1 ELSE 2 END FROM o)")
def adjacent_exact(t):
    rows = _pivot(t).join(F.broadcast(_pivot(t).agg(F.bround(F.median("start"), 0).cast("long").alias("m"))))
    return T.neighbours(rows, F.col("m"), F.col("m"), 2, forward=False, include_range=False).select("key", "start", "rank")


@book.query("SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10)::bigint AS batch FROM events")
def fixed_batches(t):
    return T.batch_rows(t("events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "batch")


@book.query('SELECT "window", count(*) AS n, sum(event_id)::bigint AS ids FROM (SELECT event_id, unnest(range(greatest(floor((event_id - 100) / 50.0)::bigint + 1, 0), event_id // 50 + 1)) AS "window" FROM events) GROUP BY ALL')
def hop_batches(t):
    return T.hop_windows(t("events"), F.col("event_id"), 100, 50).groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@book.query("SELECT o_orderkey, array_to_string([o_orderkey + (i * (o_custkey * 3)) // 6 FOR i IN range(1, 6)], ',') AS picks FROM orders")
def even_frame_picks(t):
    picks = C.even_picks(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") * 3, 5)
    return t("orders").select("o_orderkey", F.array_join(picks.cast("array<string>"), ",").alias("picks"))


@book.query("""
    SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS code, round(ms / 1000.0, 3) AS seconds, floor(ms / 1000.0 * 25)::bigint AS frame
    FROM (SELECT event_id, round(value * 1000)::bigint AS ms FROM events)""")
def timecode_round_trip(t):
    code = C.seconds_to_timecode(F.col("value"))
    rows = t("events").select("event_id", code.alias("code")).withColumn("seconds", F.round(C.time_to_seconds(F.col("code")), 3))
    return rows.withColumn("frame", C.time_to_frame(F.col("seconds"), F.lit(25.0)))


@book.query("""
    SELECT conv_id, run, role, count(*) AS n, string_agg(text, '' ORDER BY turn) AS text FROM (
        SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::bigint AS run FROM (
            SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS new
            FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role, text)))
    GROUP BY conv_id, run, role""")
def block_run_merge(t):
    from velarium.operators.store import latest

    once = latest(t("conversations"), ["conv_id", "turn"], [F.col("role"), F.col("text")])
    return T.runs_merged(once, "conv_id", ["turn"], ["role"], "text")


QUERIES, ORACLE_SQL = book.queries, book.sql
