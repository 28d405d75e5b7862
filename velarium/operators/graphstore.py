"""A graph kept as tables: typed collections, loads that are checked and appear whole or not at all, and deletion of videos with all that hangs on them.

A folder holds `data/<collection>/<load>` and `versions/<number>`, the list of the folders that make up a state. A load writes its collections first and the list last, so readers see the state before or
the state after. One writer at a time: a second that makes the same version fails, as its list is there already. A state that was read stays readable until `sweep`.

Vertices have `key`; edges have `src`, `dst`, `edge_type` and a key of these, so loading rows again replaces them. Of rows of equal key one stays, see `store.one_of_each`. A null key is an error.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators.store import delete_by, keyed_edges, upsert

#: Edge collections with the collections of their ends (fixed values).
EDGES = {
    "entity_relations": ("entities", "entities"),
    "event_sequences": ("events", "events"),
    "event_entities": ("events", "entities"),
    "micro_event_sequences": ("micro_events", "micro_events"),
    "micro_event_parents": ("micro_events", "events"),
    "micro_event_entities": ("micro_events", "entities"),
    "community_members": ("entities", "communities"),
    "event_communities": ("events", "communities"),
}
VERSION = "collection string, folder string"


class WrongEdges(ValueError):
    """A load's edges whose ends are in no collection of the right type."""


def wrong_edges(state: dict[str, DataFrame], edges: dict[str, tuple[str, str]] = EDGES, of: set[str] | None = None) -> DataFrame | None:
    """(collection, key, side, missing) of edges whose end is not in the collection that its definition names, by one anti-join a side; none if the state has no edges. `of` limits the edge collections."""
    found = None
    for name, ends in edges.items():
        if name not in state or (of is not None and name not in of):
            continue
        for side, collection in zip(("src", "dst"), ends, strict=True):
            rows = state[name].select("key", F.col(side).cast("string").alias("missing"))
            if collection in state:
                rows = rows.join(state[collection].select(F.col("key").cast("string").alias("missing")), "missing", "left_anti")
            rows = rows.select(F.lit(name).alias("collection"), "key", F.lit(side).alias("side"), "missing")
            found = rows if found is None else found.unionByName(rows)
    return found


def unknown_ends(state: dict[str, DataFrame], edges: dict[str, tuple[str, str]] = EDGES, of: set[str] | None = None) -> bool:
    """Whether `wrong_edges` has a row: only distinct ends meet the vertices."""
    for name, ends in edges.items():
        if name in state and (of is None or name in of):
            for side, collection in zip(("src", "dst"), ends, strict=True):
                asked = state[name].select(F.col(side).cast("string").alias("key")).distinct()
                if collection in state:
                    asked = asked.join(state[collection].select(F.col("key").cast("string").alias("key")), "key", "left_anti")
                if not asked.isEmpty():
                    return True
    return False


def loaded(old: dict[str, DataFrame], new: dict[str, DataFrame], edges: dict[str, tuple[str, str]] = EDGES) -> dict[str, DataFrame]:
    """The state after a load: rows of `new` replace those of equal key."""
    state = dict(old)
    for name, rows in new.items():
        rows = keyed_edges(rows) if name in edges else rows
        state[name] = upsert(old[name], rows, ["key"]) if name in old else upsert(rows.limit(0), rows, ["key"])
    return state


def without_videos(state: dict[str, DataFrame], videos: DataFrame, edges: dict[str, tuple[str, str]] = EDGES) -> dict[str, DataFrame]:
    """The state after videos (video_id) go.

    Vertices of the videos go; edges go that are of the videos or have an end among the vertices that went. Collections without video_id lose nothing of their own.
    """
    ids = videos.select("video_id").distinct()
    left = {n: delete_by(df, ids, "video_id") if "video_id" in df.columns else df for n, df in state.items()}
    # a null video is none of those that go
    gone = {n: df.join(ids, "video_id", "left_semi").select(F.col("key").cast("string").alias("key")) for n, df in state.items() if "video_id" in df.columns and n not in edges}
    for name, ends in edges.items():
        if name in left:
            for side, collection in zip(("src", "dst"), ends, strict=True):
                if collection in gone:
                    # keys of vertices stand for the edges' ends as text
                    left[name] = left[name].join(gone[collection].select(F.col("key").alias("_end")), F.col(side).cast("string") == F.col("_end"), "left_anti")
    return {n: df.select(*state[n].columns) for n, df in left.items()}


def lost_rows(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(collection, deleted): how many rows less each collection has."""
    signed = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("collection"), (k * F.col("n")).alias("n")) for s, k in ((before, 1), (after, -1)) for n, df in s.items()]
    return reduce(DataFrame.unionByName, signed).groupBy("collection").agg(F.sum("n").cast("long").alias("deleted"))


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str, edges: dict[str, tuple[str, str]] = EDGES) -> None:
        self.spark, self.folder, self.edges = spark, folder, edges
        self.files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _children(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def version(self) -> int:
        """The number of the last whole state, 0 before any."""
        whole = [int(v) for v in self._children("versions") if v.isdigit() and self.files.exists(self._path("versions", v, "_SUCCESS"))]
        return max(whole, default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        return {r["collection"]: r["folder"] for r in self.spark.read.schema(VERSION).parquet(f"{self.folder}/versions/{version}").collect()}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The collections of a state, the last by default."""
        return {n: self.spark.read.parquet(f"{self.folder}/data/{n}/{at}") for n, at in self.folders(version).items()}

    def _commit(self, state: dict[str, DataFrame], changed: set[str], check: set[str]) -> int:
        """Write the changed collections, check edges against what was written, then write the list."""
        before, now = self.version(), self.folders()
        for name in sorted(changed):
            now[name] = uuid.uuid4().hex
            state[name].write.parquet(f"{self.folder}/data/{name}/{now[name]}")
        written = {n: self.spark.read.parquet(f"{self.folder}/data/{n}/{at}") for n, at in now.items()}
        wrong = wrong_edges(written, self.edges, check) if unknown_ends(written, self.edges, check) else None
        if wrong is not None and (first := wrong.orderBy("collection", "key", "side").limit(10).collect()):
            raise WrongEdges("; ".join(f"{r['collection']} {r['key']}: no {r['side']} {r['missing']}" for r in first))
        self.spark.createDataFrame(sorted(now.items()), VERSION).coalesce(1).write.parquet(f"{self.folder}/versions/{before + 1}")
        return before + 1

    def load(self, new: dict[str, DataFrame]) -> int:
        """Load collections; the number of the new state. Edges are checked if they or a collection of their ends are loaded; a wrong edge fails the load, which then changes nothing."""
        check = {e for e, ends in self.edges.items() if e in new or set(ends) & set(new)}
        return self._commit(loaded(self.read(), new, self.edges), set(new), check)

    def delete_videos(self, videos: DataFrame) -> DataFrame:
        """Delete videos and what hangs on them; the rows that each collection lost."""
        before = self.read()
        if not before:
            return self.spark.createDataFrame([], "collection string, deleted long")
        after = without_videos(before, videos, self.edges)
        self._commit(after, set(after), set())
        return lost_rows(before, self.read())

    def sweep(self, keep: int = 2) -> int:
        """Delete what only states before the last `keep` hold, and loads that failed; how many folders went. Not while a load runs."""
        last = self.version()
        held = {(n, at) for v in range(max(1, last - keep + 1), last + 1) for n, at in self.folders(v).items()}
        for v in self._children("versions"):
            if not v.isdigit() or not last - keep < int(v) <= last:
                self.files.delete(self._path("versions", v), True)
        gone = [(n, at) for n in self._children("data") for at in self._children("data", n) if (n, at) not in held]
        for n, at in gone:
            self.files.delete(self._path("data", n, at), True)
        return len(gone)
