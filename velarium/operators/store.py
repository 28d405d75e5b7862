"""Mutations as functions from tables to their next state; the caller writes the result (overwrite, or a MERGE where the format has one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def one_of_each(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Of rows with equal keys the last by `order` (null orders first); of rows that agree in it, or without it, the last as JSON text. Rows are dealt by key once as they are; the text is made where they meet and is never shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    last = F.struct(*([F.col(order).isNotNull().alias("known"), F.col(order).alias("order")] if order else []), F.to_json(whole).alias("text"))
    best = rows.repartition(*keys).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(whole, last).alias("_r"))
    return best.select("_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of `new` replace rows of `old` with equal keys; of several new rows one stays, see `one_of_each`. A null key is an error."""
    new = one_of_each(new, keys, version)
    for k in keys:
        new = new.withColumn(k, F.coalesce(F.col(k), F.raise_error(F.lit(f"missing {k}")).cast(new.schema[k].dataType)))
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ascending columns, nulls first, in one aggregation that combines map-side."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def delete_by(rows: DataFrame, ids: DataFrame, on: str, id_col: str | None = None) -> DataFrame:
    """Rows whose `on` is not among the ids."""
    return rows.join(ids.select(F.col(id_col or ids.columns[0]).alias(on)), on, "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Delete the ids from every table by its column: next states, and one-row counts of what went."""
    left = {n: delete_by(df, ids, col) for n, (df, col) in tables.items()}
    gone = {n: df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).withColumn("table", F.lit(n)) for n, (df, col) in tables.items()}
    return left, gone


def lineage_rows(artifacts: DataFrame, key: str, parents: str) -> DataFrame:
    """(parent, child) of distinct parents that are not empty."""
    kept = F.array_distinct(F.filter(parents, lambda p: p.isNotNull() & (p != "")))
    return artifacts.select(F.explode(kept).alias("parent"), F.col(key).alias("child"))


def merged_metadata(metadata: Column, columns: Column) -> Column:
    """The union of two string maps; the second wins on shared keys."""
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(columns), k)), columns)


def toggled(old: DataFrame, picks: DataFrame, keys: list[str], flag: str = "selected") -> DataFrame:
    """Flip the flag of picked rows; picks without a row become rows with true."""
    marked = picks.select(*keys).distinct().withColumn("_picked", F.lit(True))
    both = old.join(marked, keys, "full")
    value = F.when(F.col("_picked") & F.col(flag).isNotNull(), ~F.col(flag)).when(F.col("_picked"), F.lit(True)).otherwise(F.col(flag))
    return both.withColumn(flag, value).drop("_picked")


def matched_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Logins (login_id, email) and the user each belongs to: by login id, else by email, else none (a new user)."""
    by_id = users.select(F.col("login_id"), F.col("user_id").alias("_by_id"))
    by_mail = users.groupBy("email").agg(F.min("user_id").alias("_by_mail"))
    return logins.join(by_id, "login_id", "left").join(by_mail, "email", "left").select("login_id", "email", F.coalesce("_by_id", "_by_mail").alias("user_id"), (F.col("_by_id").isNull() & F.col("_by_mail").isNull()).alias("is_new"))


def filled(rows: DataFrame, column: str, value) -> DataFrame:
    """Backfill a column where it is null."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def renamed_row(rows: DataFrame, key: str, at, column: str, value) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(key) == at, F.lit(value)).otherwise(F.col(column)))


def left_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict, order: str | None = None) -> DataFrame:
    """Left rows with the right side's columns, or defaults. Of repeated right rows one stays whole: the last by `order`, else the greatest row."""
    cols = list(defaults)
    whole = F.struct(*cols)
    once = right.groupBy(*keys).agg(F.max_by(whole, F.col(order) if order else whole).alias("_r")).select(*keys, "_r.*")
    return left.join(once, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def points(rows: DataFrame, key: str, vectors: dict[str, int], payload: list[str]) -> DataFrame:
    """Rows as vector points: named vectors of the right size (null otherwise) and a payload; a null key is an error."""
    made = [F.when(F.size(v) == n, F.col(v)).alias(v) for v, n in vectors.items()]
    ident = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit("point without id")).cast("string"))
    return rows.select(ident.alias("id"), *made, F.struct(*payload).alias("payload"))


def inserted_users(users: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users after a round of logins, and the default groups of the new ones. A new user's id is made of the login id; a login of a known e-mail takes over its user's login id."""
    matched = matched_users(users, logins)
    fresh = matched.filter("is_new").select(F.concat(F.lit("user_"), F.col("login_id").cast("string")).alias("user_id"), "login_id", "email").groupBy("user_id", "login_id").agg(F.min("email").alias("email"))
    taken = matched.filter("NOT is_new").groupBy("user_id").agg(F.max("login_id").alias("_login"))
    kept = users.join(taken, "user_id", "left").withColumn("login_id", F.coalesce("_login", "login_id")).drop("_login")
    groups = fresh.select(F.concat(F.lit("group_"), F.col("login_id").cast("string")).alias("group_id"), "user_id", F.lit("default").alias("name"))
    return kept.unionByName(fresh.withColumn("user_id", F.col("user_id").cast(users.schema["user_id"].dataType)), allowMissingColumns=True), groups


def deleted_group(tables: dict[str, tuple[DataFrame, str]], groups: DataFrame) -> dict[str, DataFrame]:
    """The next states after groups (group_id) go: the groups, their sessions' picks and their videos, each table by the column that names the group."""
    return cascade(tables, groups)[0]


def touched_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions (session_id, user_id, created, last_updated) after messages (session_id, user_id, at): missing ones are made, the others move on to their last message."""
    last = messages.groupBy("session_id").agg(F.min_by("user_id", "at").alias("_user"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    both = sessions.join(last, "session_id", "full")
    return both.select("session_id", F.coalesce("user_id", "_user").alias("user_id"), F.coalesce("created", "_first").alias("created"), F.greatest("last_updated", "_last").alias("last_updated"))


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type, ...) with a key of their ends and type, so that loading them again replaces them."""
    return edges.withColumn("key", F.substring(F.sha2(F.concat_ws("|", "src", "dst", "edge_type"), 256), 1, 24))


def graph_load(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load vertex and edge collections (edges are those with src and dst): rows of equal key are replaced. Next states, and the rows given to each collection with a total."""
    state, counts = {}, []
    for name, rows in new.items():
        rows = keyed_edges(rows) if {"src", "dst"} <= set(rows.columns) else rows
        rows = one_of_each(rows, ["key"])
        state[name] = upsert(old[name], rows, ["key"]) if name in old else rows
        counts.append(rows.agg(F.count(F.lit(1)).alias("inserted")).select(F.lit(name).alias("collection"), "inserted"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    total = every.rollup("collection").agg(F.sum("inserted").alias("inserted"), F.grouping("collection").alias("_t"))
    return state | {n: df for n, df in old.items() if n not in new}, total.select(F.when(F.col("_t") == 1, "TOTAL").otherwise(F.col("collection")).alias("collection"), "inserted")


def create_table(spark: SparkSession, name: str, columns: str) -> bool:
    """Make a table if there is none of the name; whether it was made. A table made by another in between counts as there."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return not there


def retried(videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """(video_id, url) of the wanted ids that are there; others are passed over."""
    return videos.join(wanted.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "url")


def ingested(videos: DataFrame, status: str = "status") -> DataFrame:
    """Videos with `ingested`: a status of 100 or more."""
    return videos.withColumn("ingested", F.coalesce(F.col(status), F.lit(0)) >= 100)


def run_status(rows: DataFrame, updates: DataFrame, key: str = "video_id") -> DataFrame:
    """Status set from updates (key, status, run_id); a run id is taken only where there is none."""
    new = updates.select(key, F.col("status").alias("_status"), F.col("run_id").alias("_run"))
    return rows.join(new, key, "left").withColumns({"status": F.coalesce("_status", "status"), "run_id": F.coalesce("run_id", "_run")}).drop("_status", "_run")
