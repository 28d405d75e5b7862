"""A stored inverted index of a text field: BM25 and fuzzy terms without reading the texts again.

An index is a folder of Parquet tables, each by segment (what was added at once) and by `shard`, the hash of its key:

* `postings` (term, block, key, tf, dl), files sorted by term and block, so that a question reads its terms' folders, and in them the row groups of its terms;
* `bounds` (term, block, n, tf, dl): of each block of documents the greatest tf and the least length, which bound a term's part of the score whatever the other segments hold;
* `terms` (term, df) and `variants` (variant, term): each term under what is left of its first PREFIX letters when up to two go. Two words within two edits share such a rest (an alignment of the words
  leaves at most as many letters of either beginning unmatched as it has edits), so no term is missed and a term has 29 rows at most;
* `segments` (segment, kind, n, length, replaces): a segment counts from the moment its row is here, which is written last, until a merge replaces it.

A document's block is the hash of its key. The k best documents come in two steps: the blocks of greatest bound are scored, and then those whose bound reaches the k-th score; others are never read. The
result is that of a scan, ties included. What goes through the driver: a row a segment, a row a query term, and up to LISTED block numbers (more are joined).

Null texts aren't documents; keys are unique and not null. A frequent term is dealt to `spread` files of its shard by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from velarium.functions import text as T
from velarium.operators.scope import top
from velarium.shared import ship

K1, B = 1.2, 0.75
PREFIX, LISTED = 7, 2000
#: Documents whose terms a task counts at once.
DOCS = 500
_POSTED = [StructField("dl", IntegerType()), StructField("term", StringType()), StructField("tf", IntegerType())]
SEGMENTS = "segment string, kind string, n long, length long, replaces array<string>"


def automatic_edits(term: str) -> int:
    """Edits allowed for a term: none up to two characters, one up to five, two beyond."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def shortened(word: str, most: int) -> set[str]:
    """A word and what is left of it when up to `most` letters go."""
    out = {word}
    for _ in range(most):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def _shorter(words: Column) -> Column:
    """What is left of each of an array of words when one letter goes."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), one)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, dl, term, tf) of documents (key, dl, terms); a document is whole in its row, so its terms are counted there without a shuffle."""
    for whole in batches:
        for k in range(0, whole.num_rows, DOCS):
            rows = whole.slice(k, DOCS)
            lists = rows.column("terms")
            words = lists.flatten().dictionary_encode()
            size = max(1, len(words.dictionary))
            row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            found, tf = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
            row, word = pa.array(found // size), pa.array(found % size)
            yield pa.RecordBatch.from_arrays([rows.column("key").take(row), rows.column("dl").take(row), words.dictionary.take(word), pa.array(tf.astype(np.int32))], names=["key", "dl", "term", "tf"])


@dataclass(frozen=True)
class TextIndex:
    """An index of a folder. `terms` maps a text to its array of terms; a reader needs it only to add."""

    spark: SparkSession
    folder: str
    terms: Callable[[Column], Column] = T.terms
    shards: int = 16
    blocks: int = 64
    spread: int = 4

    def _shard(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.shards)).cast("int")

    def _put(self, rows: DataFrame, table: str, segment: str, key: str, *order: str) -> None:
        dealt = [F.col("shard"), F.pmod(F.xxhash64(order[0]), F.lit(self.spread))] if order else [F.col("shard")]
        rows.withColumn("shard", self._shard(F.col(key))).repartition(*dealt).sortWithinPartitions("shard", key, *order).write.partitionBy("shard").parquet(f"{self.folder}/{table}/segment={segment}")

    def add(self, docs: DataFrame, key: str, field: str) -> str:
        """Index the documents as one more segment."""
        segment = uuid.uuid4().hex
        held = docs.filter(F.col(field).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(self.terms(F.col(field)))).alias("terms")).withColumn("dl", F.size("terms"))
        block = F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int")
        ship(self.spark)
        postings = held.select("key", "dl", "terms").mapInArrow(_counted, StructType([StructField("key", docs.schema[key].dataType), *_POSTED]))
        self._put(postings.withColumn("block", block), "postings", segment, "term", "block")
        sizes = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return self._finish(segment, docs.schema[key].dataType.simpleString(), sizes["n"], sizes["length"], [])

    def _read(self, table: str, *live: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/segment={s}" for s in live]).drop("segment")

    def _finish(self, segment: str, kind: str, n: int, length: int, replaces: list[str], merged: list[str] | None = None) -> str:
        """The tables that postings give, if there are any, and at last the segment's own row."""
        if length:
            self._derive(segment, merged or [])
        row = self.spark.createDataFrame([(segment, kind, n, length, replaces)], SEGMENTS)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/segments")
        return segment

    def _derive(self, segment: str, merged: list[str]) -> None:
        """Bounds of a segment's postings, or of the segments it was merged from, which share blocks; what they hold of terms."""
        parts = self._read("bounds", *merged) if merged else self._read("postings", segment).withColumn("n", F.lit(1))
        blocks = parts.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        self._put(blocks, "bounds", segment, "term", "block")
        counted = self._read("bounds", segment).groupBy("term").agg(F.sum("n").alias("df"))
        self._put(counted, "terms", segment, "term")
        words = self._read("terms", segment).select("term")
        short = words.withColumn("head", F.array(F.substring("term", 1, PREFIX))).withColumn("one", _shorter(F.col("head")))
        every = F.array_distinct(F.concat("head", "one", _shorter(F.col("one"))))
        self._put(short.select("term", F.explode(every).alias("variant")), "variants", segment, "variant", "term")

    def _live(self) -> tuple[list[str], str, int, int]:
        """Segments that count and hold terms, the keys' type, and how many documents and terms there are."""
        rows = self.spark.read.schema(SEGMENTS).parquet(f"{self.folder}/segments").collect()
        gone = {s for r in rows for s in r["replaces"]}
        own = [r for r in rows if r["segment"] not in gone]
        return sorted(r["segment"] for r in own if r["length"]), rows[0]["kind"], sum(r["n"] for r in own), sum(r["length"] for r in own)

    def merge(self) -> str:
        """One segment of all; the old ones' files stay for readers that have begun."""
        live, kind, n, length = self._live()
        segment = uuid.uuid4().hex
        if length:
            self._put(self._read("postings", *live).drop("shard"), "postings", segment, "term", "block")
        every = [r["segment"] for r in self.spark.read.schema(SEGMENTS).parquet(f"{self.folder}/segments").collect()]
        return self._finish(segment, kind, n, length, every, live)

    def _of(self, table: str, live: list[str], key: str, values: list[str]) -> DataFrame:
        """Rows of the values' folders."""
        shards = [r["s"] for r in self.spark.range(1).select(F.explode(F.array(*[self._shard(F.lit(v)) for v in values])).alias("s")).distinct().collect()]
        return self._read(table, *live).filter(F.col("shard").isin(*shards) & F.col(key).isin(*values)).drop("shard")

    def _asked(self, query_terms: list[str]) -> tuple[list[str], list[str], dict[str, float], float]:
        words = sorted(set(query_terms))
        live, _, n, length = self._live()
        found = {r["term"]: r["df"] for r in self._of("terms", live, "term", words).groupBy("term").agg(F.sum("df").alias("df")).collect()} if words and length else {}
        idf = self.spark.range(1).select(*[F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5)).alias(f"i{k}") for k, d in enumerate(found.values())]).first() if found else ()
        return live, sorted(found), dict(zip(found, idf, strict=True)), length / n if n else 1.0

    @staticmethod
    def _part(weights: Column, average: float) -> Column:
        return F.element_at(weights, F.col("term")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))

    def _scored(self, postings: DataFrame, weights: Column, average: float) -> DataFrame:
        """(key, score); parts are added in the order of their terms."""
        parts = postings.select("key", F.struct("term", self._part(weights, average).alias("part")).alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x"))
        return parts.select("key", F.aggregate("x", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))

    def _none(self) -> DataFrame:
        return self.spark.range(0).select(F.lit(None).cast(self._live()[1]).alias("key"), F.lit(0.0).alias("score"))

    def scores(self, query_terms: list[str]) -> DataFrame:
        """(key, score) of all documents that hold a query term, as `search.bm25` gives them."""
        live, words, idf, average = self._asked(query_terms)
        if not words:
            return self._none()
        weights = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
        return self._scored(self._of("postings", live, "term", words), weights, average)

    def best(self, query_terms: list[str], k: int = 10, first: int = 8) -> DataFrame:
        """The k best (key, score), ties by key; `first` blocks are scored before the others are bounded."""
        live, words, idf, average = self._asked(query_terms)
        if not words:
            return self._none()
        weights = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
        postings = self._of("postings", live, "term", words)
        # segments share blocks: a document is in one of them
        held = self._of("bounds", live, "term", words).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        bounds = held.groupBy("block").agg(F.sum(self._part(weights, average)).alias("bound"), F.max("n").alias("n"))
        lead = bounds.orderBy(F.col("bound").desc(), "block").limit(first).collect()
        begun = top(self._scored(postings.filter(F.col("block").isin(*[r["block"] for r in lead])), weights, average), k, "key").collect()
        if len(begun) == k:  # a hair below, as sums of bounds are added in another order
            bounds = bounds.filter(F.col("bound") >= begun[-1]["score"] * (1 - 1e-9))
        reach = bounds.select("block").limit(LISTED + 1).collect()
        some = postings.filter(F.col("block").isin(*[r["block"] for r in reach])) if len(reach) <= LISTED else postings.join(bounds.select("block"), "block", "left_semi")
        return top(self._scored(some, weights, average), k, "key")

    def near_terms(self, words: list[str], most: int = 50) -> DataFrame:
        """(term, edits) of the vocabulary within the allowed edits of a word: the `most` nearest of each, ties by term."""
        words, (live, *_, length) = sorted(set(words)), self._live()
        if not words or not length:
            return self.spark.range(0).select(F.lit("").alias("term"), F.lit(0).alias("edits"))
        allowed = {w: automatic_edits(w) for w in words}
        keys = sorted({v for w, d in allowed.items() for v in shortened(w[:PREFIX], d)})
        candidates = self._of("variants", live, "variant", keys).select("term")
        edits = F.array(*[F.struct(F.lit(w).alias("word"), F.levenshtein("term", F.lit(w), d).alias("edits")) for w, d in allowed.items()])
        near = candidates.distinct().select("term", F.explode(F.filter(edits, lambda x: x["edits"] >= 0)).alias("x"))
        place = F.row_number().over(Window.partitionBy("word").orderBy("edits", "term"))
        ranked = near.select("term", "x.word", "x.edits").withColumn("place", place).filter(F.col("place") <= most)
        return ranked.groupBy("term").agg(F.min("edits").alias("edits"))
