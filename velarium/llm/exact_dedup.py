"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries pass finds the digests that may hold over `support` of the rows. Their true counts and winners are
verified by an aggregation that combines map-side, and at most 1/support of them are broadcast, so that copies of a
very frequent text are decided where they are read. Winners of all other digests come from an ordinary aggregation, which combines map-side too, and
meet their rows in one join. No task holds the rows of a digest together.

Two texts are equal if they are identical after lower-casing A-Z; null counts as the empty text. Of equal texts the row
with the largest id stays; null ids rank below all others; of rows that repeat both id and text exactly one stays. Texts of any length are read whole. An
empty table gives an empty result. Input columns named like the working columns are not touched, as those are prefixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velarium.llm.text_rules import lower_ascii
from velarium.shared import cut

_P = "__xd_"


def text_digest(text: str):
    return F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256)


def _winners(rows: DataFrame) -> DataFrame:
    """Of each digest the largest id, a row that has it, how many rows there are."""
    rid, row = f"{_P}id", f"{_P}row"
    top = F.coalesce(F.max_by(row, rid), F.max(row))
    return rows.groupBy(f"{_P}digest").agg(F.max(rid).alias(f"{_P}win"), top.alias(f"{_P}top"), F.count(F.lit(1)).alias(f"{_P}n"))


def _heavy(narrow: DataFrame, support: float) -> DataFrame:
    """The verified winners of digests of over `support` of the rows: at most 1/support rows."""
    digest = f"{_P}digest"
    found = narrow.stat.freqItems([digest], support)
    frequent = found.select(F.explode(found.columns[0]).alias(digest)).distinct()
    return cut(_winners(narrow.join(F.broadcast(frequent), digest)).filter(F.col(f"{_P}n") > F.lit(support * narrow.count())))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digest, rid, row = f"{_P}digest", f"{_P}id", f"{_P}row"
    narrow = cut(docs.select(F.col(id_col).alias(rid), text_digest(text_col).alias(digest), F.monotonically_increasing_id().alias(row)))
    heavy = F.broadcast(_heavy(narrow, support))
    light = narrow.join(heavy, digest, "left_anti")
    # written once, as which of equal rows wins may change when an aggregation is run again
    decided = narrow.join(heavy, digest).unionByName(light.join(cut(_winners(light)), digest))
    return decided.select(
        F.col(rid).alias(id_col), F.col(f"{_P}win").alias("keep_id"), F.col(f"{_P}n").alias("group_size"), (F.col(row) == F.col(f"{_P}top")).alias("kept"), F.col(digest).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows that stay, with the columns of `docs`.

    Losing copies of frequent texts go before the shuffle, and of each digest a task sends on its best row alone (the rank's limit is pushed below the shuffle).
    """
    digest, rid = f"{_P}digest", f"{_P}id"
    tagged = docs.withColumn(digest, text_digest(text_col))
    narrow = cut(tagged.select(F.col(id_col).alias(rid), digest, F.monotonically_increasing_id().alias(f"{_P}row")))
    lean = tagged.join(F.broadcast(_heavy(narrow, support)), digest, "left")
    lean = lean.filter(F.col(f"{_P}n").isNull() | F.col(id_col).eqNullSafe(F.col(f"{_P}win")))
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    first = lean.withColumn(f"{_P}rank", F.row_number().over(order)).filter(F.col(f"{_P}rank") == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
