"""Sessions and messages: history, search, grouping of media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.functions.text import snippet


def message_search(messages: DataFrame, needle: str, text: str = "text", around: int = 40) -> DataFrame:
    """Messages that hold the text in any case, with what stands around the first hit."""
    return messages.withColumn("snippet", snippet(F.col(text), needle, around)).filter(F.col("snippet").isNotNull())


def block_search(messages: DataFrame, needle: str, blocks: str = "blocks", around: int = 40) -> DataFrame:
    """As `message_search`, over the first text block of each message that holds the text."""
    hit = F.element_at(F.filter(blocks, lambda b: F.lower(b["text"]).contains(needle.lower())), 1)
    return messages.withColumn("_hit", F.when(F.exists(blocks, lambda b: F.lower(b["text"]).contains(needle.lower())), hit)).filter(F.col("_hit").isNotNull()).withColumn("snippet", snippet(F.col("_hit.text"), needle, around)).drop("_hit")


def sessions(messages: DataFrame, session: str = "conv_id", order: str = "turn", limit: int | None = None) -> DataFrame:
    """Sessions by their last message, newest first, with message counts."""
    out = messages.groupBy(session).agg(F.max(order).alias("last_updated"), F.count(F.lit(1)).alias("messages")).orderBy(F.col("last_updated").desc(), session)
    return out.limit(limit) if limit else out


def media_by_video(hits: DataFrame, video: str, start: str, fields: list[str]) -> DataFrame:
    """The hits of each video as one array in order of start."""
    return hits.groupBy(video).agg(F.array_sort(F.collect_list(F.struct(start, *[f for f in fields if f != start]))).alias("items"))
