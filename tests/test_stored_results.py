"""Kept results across sessions; folders of an application that has ended."""

from __future__ import annotations

import os
import subprocess
import sys

from tests.conftest import ROOT
from velarium.plans.stored_results import StoredResults


def test_results_are_shared_until_input_or_age_changes(spark, tmp_path):
    source, clock, made = str(tmp_path / "in"), [100.0], []
    spark.range(5).write.parquet(source)

    def ask(session, args):
        rows = session.read.parquet(source)

        def make():
            made.append(args)
            return rows.filter(f"id < {args['n']}")

        return sorted(r["id"] for r in StoredResults(session, str(tmp_path / "kept"), 50, lambda: clock[0]).get("t", args, [rows], make).collect())

    assert ask(spark, {"n": 3}) == [0, 1, 2] and len(made) == 1
    assert ask(spark.newSession(), {"n": 3}) == [0, 1, 2] and len(made) == 1
    assert ask(spark, {"n": 2}) == [0, 1] and len(made) == 2
    spark.range(1, 2).write.mode("append").parquet(source)
    assert ask(spark, {"n": 3}) == [0, 1, 1, 2] and len(made) == 3
    clock[0] = 160.0
    assert ask(spark, {"n": 3}) == [0, 1, 1, 2] and len(made) == 4
    assert StoredResults(spark, str(tmp_path / "kept"), 50, lambda: clock[0]).sweep().count() == 3


ENDING = """
import sys
from velarium.session import make_session
from velarium.shared import cut, stored
at = sys.argv[1]
spark = make_session("local[2]", 2, **{"spark.checkpoint.dir": at, "spark.sql.warehouse.dir": at + "-w"})
cut(spark.range(9)).count(), stored(spark.range(3), "x").count()
spark.stop()
"""


def test_nothing_stays_in_the_shared_folder(tmp_path):
    at = str(tmp_path / "shared")
    subprocess.run([sys.executable, "-c", ENDING, at], cwd=ROOT, check=True, capture_output=True, timeout=120)
    left = [f for folder, _, files in os.walk(at) for f in files]
    assert left == []
