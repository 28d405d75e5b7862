"""Structured Streaming jobs run over the event file, against their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from velarium.queries.base import Book
from velarium.streaming import sessions as S

book = Book()


def _stream(t):
    """A stream over the table: the folder of its part files, or the one file by a filter on its folder."""
    rows = t("events")
    folder, name = rows.inputFiles()[0].rsplit("/", 1)
    return S.event_stream(rows.sparkSession, folder, rows.schema, name if name == "events.parquet" else "*.parquet"), rows.sparkSession


@book.query("SELECT date_trunc('day', ts)::timestamp AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(t):
    stream, spark = _stream(t)
    out = S.run_to_table(S.window_counts(stream), spark, "windows", "complete")
    last = out.agg(F.max("_batch").alias("_batch"))
    return out.join(F.broadcast(last), "_batch").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@book.query("SELECT DISTINCT user_id FROM events")
def stream_dedup(t):
    stream, spark = _stream(t)
    return S.run_to_table(S.once_per_key(stream, ["user_id"], "4000 days"), spark, "dedup").select("user_id")


@book.query("""SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, sum(ch)::bigint AS changes FROM (
    SELECT user_id, value, CASE WHEN lag(event_type) OVER w IS NOT NULL AND lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id""")
def stream_session_state(t):
    stream, spark = _stream(t)
    out = S.run_to_table(S.session_totals(stream), spark, "sessions", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "changes"), "n").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 4).alias("total"), "s.changes")


@book.query("""
    WITH e AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(fresh::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number FROM e),
    g AS (SELECT user_id, number, any_value(event_type) AS kind, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total, min(ts) AS started, max(ts) AS ended FROM b GROUP BY user_id, number)
    SELECT user_id, number::bigint AS number, kind, n, total, started::timestamp AS started, ended::timestamp AS ended FROM g
    QUALIFY number < max(number) OVER (PARTITION BY user_id) OR epoch_us(ended) + 86400000000 < (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def stream_session_blocks(t):
    """Blocks of sessions by state, timers and RocksDB; those still open at the end are not there."""
    stream, spark = _stream(t)
    S.with_rocksdb(spark)
    out = S.run_to_table(S.session_blocks(stream), spark, "blocks")
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", "number", "kind", "n", F.round("total", 4).alias("total"), stamp("started"), stamp("ended"))


QUERIES, ORACLE_SQL = book.queries, book.sql
