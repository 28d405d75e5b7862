"""Line deduplication, in DataFrame operations only.

Texts are split at \\n; a line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys are hashed (MD5, so that two keys share a digest by design only),
the rows that hold a digest are counted by an aggregation that combines map-side, and digests found in at least `least_rows` rows lose all their lines except in the largest
id that holds them. The positions to drop meet their row in a join, and what stays is put together by position.

Only digests are shuffled by line; the text moves once, to meet its positions. A digest that stands in a third of all rows is one row after the partial aggregation, and its
lines are dealt out anew by adaptive execution's skew join, as both sides of that join are written tables. No task holds the lines of a digest together.

Null and empty texts are one empty line. Every row is a document; a line counts once a row however often it stands there. Null ids rank below all others. Rows that share the
largest id all keep the line, and so do rows of null ids where only such hold it. Rows that repeat both id and text lose the same lines. Texts of any length are read whole; dropping
is linear in a text's lines. An empty table gives an empty result. Columns beside the text stay as they are, also where they are named like the working columns, which are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.text_rules import lower_ascii
from velarium.shared import stored

_P = "__ld_"
ENDS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_digests(text: Column, least_chars: int) -> Column:
    """Of each line the digest of its key, null where the key has fewer than `least_chars` code points."""
    keys = F.transform(lines_of(text), lambda line: F.when(F.octet_length(line) >= least_chars, lower_ascii(F.btrim(line, F.lit(ENDS)))))
    return F.transform(keys, lambda key: F.when(F.length(key) >= least_chars, F.md5(key)))


def repeated_lines(digests: DataFrame, least_rows: int) -> DataFrame:
    """(digest, top) of digests found in at least `least_rows` rows; top is the largest id that holds one."""
    held = digests.select(f"{_P}id", F.explode(F.array_distinct(f"{_P}digests")).alias(f"{_P}digest")).filter(F.col(f"{_P}digest").isNotNull())
    counted = held.groupBy(f"{_P}digest").agg(F.count(F.lit(1)).alias(f"{_P}n"), F.max(f"{_P}id").alias(f"{_P}top"))
    return counted.filter(F.col(f"{_P}n") >= least_rows).drop(f"{_P}n")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_rows: int = 5, counts: tuple[str, str] | None = None) -> DataFrame:
    """`docs` with their texts rewritten; `counts` names two more columns: lines before dropping, and lines dropped."""
    rid, mark, at, found = f"{_P}id", f"{_P}mark", f"{_P}at", f"{_P}drop"
    text = F.col(f"`{text_col}`")
    digests = stored(docs.select(F.col(f"`{id_col}`").alias(rid), F.xxhash64(text).alias(mark), line_digests(text, least_chars).alias(f"{_P}digests")), "line-digests")
    repeated = stored(repeated_lines(digests, least_rows), "repeated-lines")
    lines = digests.select(rid, mark, F.posexplode(f"{_P}digests").alias(at, f"{_P}digest")).filter(F.col(f"{_P}digest").isNotNull())
    lost = lines.join(repeated, f"{_P}digest").filter(~F.col(rid).eqNullSafe(F.col(f"{_P}top")))
    # id and hash of the text name a row; rows that agree in both lose the same lines
    drops = stored(lost.groupBy(rid, mark).agg(F.collect_set(at).alias(found)), "dropped-lines").withColumnsRenamed({rid: f"{_P}rid", mark: f"{_P}rmark"})
    kept = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{_P}rid")) & (F.xxhash64(text) == F.col(f"{_P}rmark")), "left")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(found))
    # an array of one, so that a text is split once and not for each of its lines
    joined = F.transform(F.array(lines_of(text)), lambda lines: F.array_join(F.transform(places(lines), lambda p: F.get(lines, p)), "\n"))
    rewritten = F.when(F.col(found).isNull(), F.coalesce(text, F.lit(""))).otherwise(joined[0])
    columns = [rewritten.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        columns += [F.size(lines_of(text)).cast("long").alias(counts[0]), F.coalesce(F.size(F.col(found)), F.lit(0)).cast("long").alias(counts[1])]
    return kept.select(*columns)
