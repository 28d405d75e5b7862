"""Handles, cache keys and document keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(*parts: Column, length: int = 12) -> Column:
    """Hex digits of the MD5 of the sorted parts joined by `|`."""
    return F.substr(F.md5(F.array_join(F.array_sort(F.array(*[p.cast("string") for p in parts])), "|")), F.lit(1), F.lit(length))


def handle(tool: str, args: dict) -> str:
    """The handle of a result set: eight hex digits of the MD5 of tool and arguments."""
    import hashlib
    import json

    return hashlib.md5(json.dumps([tool, args], sort_keys=True, default=str).encode()).hexdigest()[:8]


def scoped_key(scope: Column, key: Column) -> Column:
    return F.concat_ws("::", scope.cast("string"), key.cast("string"))


def numbered_key(prefix: str, n: Column) -> Column:
    return F.format_string(prefix + "_%04d", n.cast("long"))


def strip_collection(c: Column) -> Column:
    """The key of `collection/key`; an error without a slash."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "^[^/]*/", "")).otherwise(F.raise_error(F.concat(F.lit("no collection in "), c)))


def url_parts(c: Column) -> Column:
    """(bucket, object) of `s3://bucket/object` and of `http(s)://host/bucket/object`."""
    rest = F.regexp_replace(c, r"^[a-z0-9]+://", "")
    path = F.when(c.startswith("s3://"), rest).otherwise(F.regexp_replace(rest, "^[^/]*/", ""))
    return F.struct(F.split_part(path, F.lit("/"), F.lit(1)).alias("bucket"), F.regexp_replace(path, "^[^/]*/", "").alias("object"))
