"""Session blocks of a stream in several micro-batches against the rule, with timers."""

from __future__ import annotations

import datetime as dt
import random

from velarium.streaming import sessions

START, HOUR = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)


def brute(rows, idle):
    out, open_ = [], {}
    for ts, event, user, kind, value in sorted(rows):
        b = open_.get(user)
        if b and b["kind"] == kind and ts - b["ended"] <= idle:
            b["n"], b["ended"], b["total"] = b["n"] + 1, ts, b["total"] + (value or 0)
        else:
            if b:
                out.append(b)
            open_[user] = {"user": user, "kind": kind, "n": 1, "started": ts, "ended": ts, "total": value or 0.0}
    return out, open_


def test_blocks_over_batches_equal_the_rule(spark, tmp_path):
    rng, idle = random.Random(6), 10 * HOUR
    rows = [(START + dt.timedelta(minutes=17 * k + rng.randrange(5)), k, rng.randrange(4), rng.choice("aab"), rng.choice((1.0, 2.5, None))) for k in range(900) if not 300 < k < 360]
    # a session that goes idle, and an event far later that moves the watermark
    rows += [(START, -1, 9, "a", 1.0), (START + 2000 * HOUR, 5000, 7, "a", 1.0)]
    schema = "ts timestamp, event_id long, user_id long, event_type string, value double"
    cuts = [START, START + 60 * HOUR, START + 150 * HOUR, START + 1000 * HOUR, START + 3000 * HOUR]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame([r for r in rows if a <= r[0] < b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={n}"))
    files = sorted((tmp_path / "in").rglob("*.parquet"), key=str)
    flat = tmp_path / "flat"
    flat.mkdir()
    for n, f in enumerate(files):
        (flat / f"{n}.parquet").write_bytes(f.read_bytes())
    sessions.with_rocksdb(spark)
    stream = sessions.event_stream(spark, str(flat), spark.read.parquet(str(flat)).schema, "*.parquet", files_per_trigger=1)
    found = sessions.run_to_table(sessions.session_blocks(stream, idle_seconds=36_000), spark, "blocks").collect()
    closed, still = brute(rows, idle)
    last = max(r[0] for r in rows)
    wanted = closed + [b for b in still.values() if b["ended"] + idle < last - HOUR]
    key = lambda b: (b["user"], b["kind"], b["n"], round(b["total"], 6), b["started"], b["ended"])
    assert sorted((r["user_id"], r["kind"], r["n"], round(r["total"], 6), r["started"], r["ended"]) for r in found) == sorted(map(key, wanted))
    assert 9 in {r["user_id"] for r in found} and 7 not in {r["user_id"] for r in found}
