"""Small operators over records of sessions, tools, evaluations and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.operators.metrics import numbered

#: What an uploaded video may call itself (fixed values).
VIDEO_TYPES = (
    "video/mp4",
    "video/mpeg",
    "video/avi",
    "video/quicktime",
    "video/x-msvideo",
    "video/x-ms-wmv",
    "video/x-flv",
    "video/webm",
    "video/3gpp",
    "video/3gpp2",
    "application/octet-stream",
)
VIDEO_ENDINGS = (".mp4", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".webm", ".3gp", ".mpeg", ".mpg")


def kept_columns(rows: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None, **computed: Column) -> DataFrame:
    """Only the columns of `keep` that are there, or all but those of `drop`, and computed ones."""
    out = rows.select(*[c for c in keep if c in rows.columns]) if keep is not None else rows.drop(*(drop or []))
    return out.withColumns(computed) if computed else out


def typed(rows: DataFrame, required: dict[str, str], optional: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """Hits as typed rows: required columns are cast and may not be null, optional ones have a default. A column that a value doesn't fit is an error as well."""
    out = []
    for name, kind in required.items():
        error = F.raise_error(F.lit(f"missing {name}")).cast(kind)
        out.append(F.coalesce(F.col(name).cast(kind), error).alias(name) if name in rows.columns else error.alias(name))
    for name, (kind, default) in (optional or {}).items():
        value = F.lit(default).cast(kind)
        out.append((F.coalesce(F.col(name).cast(kind), value) if name in rows.columns else value).alias(name))
    return rows.select(*out)


def shown(rows: DataFrame, kind: str) -> DataFrame:
    """Hits in the shape that a client shows: images by time and frame, speech and segments by ranges."""
    span = F.struct(F.col("frame_start").alias("start"), F.col("frame_end").alias("end")).alias("frames") if kind != "image" else None
    match kind:
        case "image":
            cols = [F.col("timestamp").alias("time"), F.col("frame_index").alias("frame"), "image_uri"]
        case "audio":
            cols = [F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end")).alias("time_range"), span, "text"]
        case "segment":
            cols = [F.col("start_time").alias("time_start"), F.col("end_time").alias("time_end"), span, "caption"]
        case _:
            raise ValueError(f"no shape for {kind}")
    return rows.select("rank", "score", "video_id", *cols)


def valid_upload(mime: Column, name: Column) -> Column:
    """Whether the type in any case, or the ending of the name as it is, is one of a video."""
    return F.lower(F.coalesce(mime, F.lit(""))).isin(*VIDEO_TYPES) | F.coalesce(name.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in VIDEO_ENDINGS) + ")$"), F.lit(False))


def named_steps(steps: Column) -> Column:
    """Tool steps that have a name."""
    return F.filter(steps, lambda s: s["name"].isNotNull() & (s["name"] != ""))


def without_id(rows: Column, ident) -> Column:
    """An array of structs without those of an id."""
    return F.filter(rows, lambda r: ~r["id"].eqNullSafe(F.lit(ident)))


def messages_of_user(messages: DataFrame, sessions: DataFrame, user) -> DataFrame:
    """A user's messages with the names of their sessions."""
    own = sessions.filter(F.col("user_id") == user).select("session_id", F.col("name").alias("session_name"))
    return messages.join(own, "session_id")


def fetched(keys: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows of fused keys, in one join; keys without a row go."""
    return rows.join(keys, key)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in an order; order columns ascend."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def history(messages: DataFrame) -> DataFrame:
    """Messages as an agent reads them: without id, session and time."""
    return messages.drop("id", "session_id", "timestamp")


def replayed(blocks: DataFrame, session: str = "session_id", order: str = "n") -> DataFrame:
    """What a client that comes back needs, one row a session: its finished blocks in order, and the text so far of the one that is not finished."""
    done = F.array_sort(F.collect_list(F.when(F.col("finished"), F.struct(order, "text"))))
    return blocks.groupBy(session).agg(
        F.transform(done, lambda b: b["text"]).alias("finished"), F.coalesce(F.max_by(F.when(~F.col("finished"), F.col("text")), F.when(~F.col("finished"), F.col(order))), F.lit("")).alias("in_progress")
    )


def tagged_json(rows: DataFrame, kind: str | Column, *columns: str) -> DataFrame:
    """Each row as JSON text with the name of its kind, or of the kind that a column says."""
    named = kind if isinstance(kind, Column) else F.lit(kind)
    return rows.select(F.to_json(F.struct(named.alias("event"), *columns)).alias("json"))


def json_kind(text: Column) -> Column:
    """What tool output holds: `object`, `list`, `scalar`, or `text` if it is no JSON."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return F.when(parsed.isNull(), "text").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list").otherwise("scalar")


def parsed_answer(text: Column, schema: str) -> Column:
    """A model's answer as a struct: code fences go, text that is no JSON is null."""
    from velarium.functions.text import unfenced_json

    plain = unfenced_json(text)
    return F.when(F.try_parse_json(plain).isNotNull(), F.from_json(plain, schema))


def first_answer(tries: list[Column], schema: str) -> Column:
    """The first of several answers that fits."""
    return F.coalesce(*[parsed_answer(t, schema) for t in tries])


def scrolled(rows: DataFrame, limit: int = 1000, vectors: bool = False, vector: str = "embedding", **wanted) -> DataFrame:
    """Rows of a payload filter, with or without their vectors."""
    from velarium.operators.scope import in_scope

    out = in_scope(rows, **wanted).limit(limit)
    return out if vectors else out.drop(vector)


def keyword_page(rows: DataFrame, column: str, value, order: str, size: int = 100) -> DataFrame:
    """Rows whose keyword equals a value, in order."""
    return rows.filter(F.col(column) == value).orderBy(order).limit(size)


def preview(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """One row: how many there are, and the first n."""
    first = rows.orderBy(order).limit(n).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))).alias("first"))
    return rows.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(first))


def by_time(rows: DataFrame, column: str, parsed: bool = False) -> DataFrame:
    """Rows by frame or by time as text, or by the seconds of a timecode; what can't be read comes last."""
    from velarium.functions.timecode import parse_time_safe

    return rows.orderBy((parse_time_safe(F.col(column)) if parsed else F.col(column)).asc_nulls_last(), column)


def trace(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Evaluation records (session_id, expected_video_ids) with what the run did (session_id, tool, output_video_ids, ok, seconds): tools, failures, time, and recall of the expected videos."""
    run = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.sum("seconds"), 3).alias("seconds"), F.array_distinct(F.flatten(F.collect_list("output_video_ids"))).alias("found")
    )
    out = records.join(run, "session_id", "left")
    wanted = F.array_distinct("expected_video_ids")
    hit = F.size(F.array_intersect(wanted, F.coalesce("found", F.array().cast("array<string>"))))
    recall = F.when(F.size(wanted) > 0, F.round(hit / F.size(wanted), 4))
    return out.select("session_id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce(F.size(wanted) > 0, F.lit(False)).alias("has_expectations"), recall.alias("recall"))


def compact_record(facts: Column) -> Column:
    """Facts of a record, strings or (fact, source) structs as JSON, as structs without empty ones."""
    as_struct = F.transform(facts, lambda f: F.coalesce(F.from_json(f, "fact string, source string"), F.struct(f.alias("fact"), F.lit(None).cast("string").alias("source"))))
    plain = F.transform(F.arrays_zip(facts.alias("raw"), as_struct.alias("s")), lambda x: F.when(x["s"]["fact"].isNull(), F.struct(x["raw"].alias("fact"), F.lit(None).cast("string").alias("source"))).otherwise(x["s"]))
    return F.filter(plain, lambda f: f["fact"].isNotNull() & (f["fact"] != ""))


#: Parts of tool names and what their icon shows, first match first; `default` where none is in the name (fixed values).
ICONS = {
    "ocr": "document",
    "text_recognition": "document",
    "voice": "microphone",
    "voice_recognition": "microphone",
    "speech": "microphone",
    "asr": "microphone",
    "clip": "photo",
    "image_search": "photo",
    "image_analyzing": "eye",
    "image_analysis": "eye",
    "image_recognition": "eye",
    "analyze": "eye",
    "search": "magnifier",
    "default": "chip",
}


def icon(name: Column) -> Column:
    """What the icon of a tool shows: the first part that its name holds, in any case and with runs of white space as `_`; names that are null or hold none have the default's."""
    plain = F.regexp_replace(F.lower(name), r"\s+", "_")
    found = [F.when(F.contains(plain, F.lit(part)), F.lit(shown)) for part, shown in ICONS.items()]
    return F.coalesce(*found, F.lit(ICONS["default"]))


def _places(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with `_place`, their number within their group; null where a group's key is null. No group is sorted in one task."""
    placed = numbered(rows, [*by, *order], "_number")
    first = placed.groupBy(*by).agg(F.min("_number").alias("_first"))
    return placed.join(first, by, "left").withColumn("_place", F.col("_number") - F.col("_first")).drop("_number", "_first")


def ordinal_join(left: DataFrame, right: DataFrame, value: str, by: list[str], order: list[str], other: list[str] | None = None) -> DataFrame:
    """Rows of `left` with the array `value` of the row of `right` at the same place of their group, or an empty array where the right side is shorter.

    Places are counted within `by`, by `order` on the left and `other` (the same names by default) on the right; the orders must be total for places to be sure. Rows of the right side beyond the left one's
    last go, a null array counts as empty, and a row whose group has a null key has no partner.
    """
    short = _places(right.select(*dict.fromkeys([*by, *(other or order), value])), by, other or order).select(*by, "_place", F.col(value).alias("_value"))
    both = _places(left.drop(value), by, order).join(short, [*by, "_place"], "left")
    return both.withColumn(value, F.coalesce("_value", F.array().cast(right.schema[value].dataType))).drop("_place", "_value")
