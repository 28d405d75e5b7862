"""Benchmark decontamination by a distributed positional inverted index.

The training side is stored once as index segments of some hundred documents: all distinct words of the segment in order and, for each, the sorted places
at which it stands. Places number the words of the segment's documents one after the other, with one place left free between two documents. A
segment holds all postings of its documents, so lists are intersected where they lie and no posting is shuffled. The test side comes in blocks of
bounded words; each block is broadcast and asked of the same stored index.

A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. Of each window the places of
its rarest term in the segment are kept that have every other term less than `span` words away. On what is left of them, less the term's offset, the
next rarest terms' offset-adjusted lists are intersected until none is left or all words agree: exact phrases. A proximity match
is a stretch of at most `span` words of one document that holds every distinct term of a window, in any order (`span` is at least `size`, so every phrase is one).

Null and blank texts have no words; an item without words has no window; items with a null id hit words but are not listed; equal item
ids count once. Repeated documents are each reported; texts of any length are indexed whole (a long one is a segment by itself). Columns of the input
other than id and text are not read by the searches and are kept by `decontaminate`, whatever their names. Empty tables give empty results or, for an
empty benchmark, no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.text_rules import ALNUM, ALNUM_BYTES, lower_text, words_of
from velarium.shared import cut, ship, stored

SEGMENT = "ids array<string>, keys array<long>, n_words array<int>, terms array<string>, ends array<int>, places array<int>"
SEGMENT_DOCS, SEGMENT_BYTES = 500, 4_000_000
#: A row of the index has megabytes, and writers look at their buffers' size only after a hundred rows: they look at each, and what a reader decodes at once stays small.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


class TestSide:
    """A block of test items: a vocabulary and the distinct windows with their items, in flat arrays (a task holds some 40 bytes a window and its items' names)."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = 10) -> None:
        vocabulary: dict[str, int] = {}
        names = sorted({n for n, _ in items if n is not None})
        code = {n: k for k, n in enumerate(names)}
        tables, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for name, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ALNUM.findall(lower_text(text))], np.int32)
            if len(ids):
                own = np.lib.stride_tricks.sliding_window_view(ids, size) if len(ids) >= size else np.r_[ids, np.full(size - len(ids), -1, np.int32)][None]
                tables.append(own)
                owners.append(np.full(len(own), code.get(name, -1), np.int64))
        self.terms = pa.array(list(vocabulary), pa.string())
        self.table, at = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
        owner, at = np.concatenate(owners), at.reshape(-1).astype(np.int64)
        self.table[self.table < 0] = len(vocabulary)  # the last id stands for nothing
        # a window's names once each, in order, end to end
        pairs = np.unique((at * max(1, len(names)) + owner)[owner >= 0])
        self.named, self._names = pairs % max(1, len(names)), names
        self._ends = np.cumsum(np.bincount(pairs // max(1, len(names)), minlength=len(self.table)))

    def window(self, k: int) -> tuple[int, ...]:
        return tuple(t for t in self.table[k].tolist() if t < len(self.terms))

    def names(self, k: int) -> list[str]:
        return [self._names[n] for n in self.named[self._ends[k - 1] if k else 0 : self._ends[k]].tolist()]


def blocks(items: DataFrame, item_col: str, text_col: str, size: int, words: int) -> Iterator[TestSide]:
    """Test items in blocks of about `words` words each; the driver holds one block at a time."""
    held, n = [], 0
    for row in items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((row["i"], row["t"]))
        n += len(row["t"] or "") // 5 + 1
        if n >= words:
            yield TestSide(held, size)
            held, n = [], 0
    yield TestSide(held, size)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most SEGMENT_DOCS documents and about SEGMENT_BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        start, n = 0, 0
        for k, size in enumerate(sizes.tolist()):
            n += size
            if n >= SEGMENT_BYTES or k + 1 - start >= SEGMENT_DOCS or k + 1 == len(sizes):
                yield batch.slice(start, k + 1 - start)
                start, n = k + 1, 0


def build_index(docs: DataFrame) -> DataFrame:
    """Store the postings of all terms in documents (id, key, text): one row for each segment of them."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            words, sizes = words_of(part.column(2), ALNUM_BYTES)
            found = words.dictionary_encode()
            order = pc.sort_indices(found.dictionary).to_numpy()
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            term = rank[found.indices.to_numpy()]
            places = np.arange(len(term), dtype=np.int32) + np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            lists = [
                (part.column(0), pa.string()), (part.column(1), pa.int64()), (sizes, pa.int32()), (found.dictionary.take(pa.array(order)), pa.string()),
                (np.cumsum(np.bincount(term, minlength=len(order))), pa.int32()), (places[np.argsort(term, kind="stable")], pa.int32()),
            ]
            columns = []
            for values, kind in lists:
                flat = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values.astype(np.int32), kind)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "keys", "n_words", "terms", "ends", "places"])

    return stored(docs.select("id", "key", "text").mapInArrow(segments, SEGMENT), "postings", compression="zstd", **SMALL_GROUPS)


class Segment:
    """The lists of one index row that a block of test items asks for."""

    def __init__(self, batch: pa.RecordBatch, row: int, terms: pa.Array) -> None:
        values = {name: batch.column(k)[row].values for k, name in enumerate(batch.schema.names)}
        self.ids = values["ids"]
        self.keys, self.n_words, ends, self.places = (values[k].to_numpy(zero_copy_only=False) for k in ("keys", "n_words", "ends", "places"))
        self.starts = np.r_[0, np.cumsum(self.n_words.astype(np.int64) + 1)][:-1]
        at = pc.index_in(terms, value_set=values["terms"]).fill_null(-1).to_numpy()
        self.there = at >= 0
        edges = np.r_[0, ends]
        self.first, self.last = edges[at], edges[np.minimum(at + 1, len(ends))]
        self.sizes = self.last - self.first

    def of(self, term: int) -> np.ndarray:
        return self.places[self.first[term] : self.last[term]]

    def close(self, terms: list[int], span: int) -> np.ndarray:
        """Places of the first term that have every other one less than `span` words away."""
        at = self.of(terms[0])
        for t in terms[1:]:
            have = self.of(t)
            right = np.searchsorted(have, at)
            up, down = have[np.minimum(right, len(have) - 1)], have[np.maximum(right - 1, 0)]
            at = at[(np.abs(up - at) < span) | (np.abs(down - at) < span)]
            if not len(at):
                break
        return at

    def phrase(self, window: tuple[int, ...], order: list[int], at: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase, of places `at` of its rarest term, by intersection with the next rarest terms' lists."""
        starts = at - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            have, want = self.of(window[k]), starts + k
            slot = np.minimum(np.searchsorted(have, want), len(have) - 1)
            starts = starts[have[slot] == want]
        return starts

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def gathered(self, terms: list[int], at: int, span: int) -> bool:
        """Whether a stretch of at most `span` words of one document holds the place and all terms."""
        d = int(self.document(np.array([at]))[0])
        low, high = max(at - span + 1, int(self.starts[d])), min(at + span - 1, int(self.starts[d]) + int(self.n_words[d]) - 1)
        around = []
        for k, t in enumerate(terms):
            have = self.of(t)
            around += [(int(p), k) for p in have[np.searchsorted(have, low) : np.searchsorted(have, high, side="right")]]
        around.sort()
        last = [-(1 << 40)] * len(terms)
        for p, k in around:
            last[k] = p
            if min(last) > p - span:
                return True
        return False


HITS = "id string, key long, n_words long, hits array<int>, items array<string>, near array<string>"


def search(index: DataFrame, side: TestSide, span: int = 20) -> DataFrame:
    """One row per document of the index: id, key, n_words, positions of hit words, ids of the items with occurring windows and with proximity matches."""
    tests = index.sparkSession.sparkContext.broadcast(side)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = tests.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row, side.terms)
                words, items, near = defaultdict(set), defaultdict(set), defaultdict(set)
                for k in np.flatnonzero(np.r_[segment.there, True][side.table].all(axis=1)).tolist():
                    window, sizes = side.window(k), segment.sizes
                    terms = sorted(set(window), key=lambda t: (sizes[t], t))
                    at = segment.close(terms, span)
                    if not len(at):
                        continue
                    rank, names = {t: r for r, t in enumerate(terms)}, side.names(k)
                    order = sorted(range(len(window)), key=lambda j: (rank[window[j]], j))
                    starts = segment.phrase(window, order, at)
                    for d, start in zip(segment.document(starts).tolist(), starts.tolist(), strict=True):
                        words[d].update(range(start - int(segment.starts[d]), start - int(segment.starts[d]) + len(window)))
                        items[d].update(names)
                        near[d].update(names)
                    for d, p in zip(segment.document(at).tolist(), at.tolist(), strict=True):
                        if not near[d].issuperset(names) and segment.gathered(terms, p, span):
                            near[d].update(names)
                n = len(segment.keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        segment.ids,
                        pa.array(segment.keys, pa.int64()),
                        pa.array(segment.n_words.astype(np.int64)),
                        pa.array([sorted(words.get(d, ())) for d in range(n)], pa.list_(pa.int32())),
                        *(pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.string())) for found in (items, near)),
                    ],
                    names=["id", "key", "n_words", "hits", "items", "near"],
                )

    return index.mapInArrow(hits, HITS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 10, block_words: int = 500_000, span: int = 20) -> DataFrame:
    """One row per document: id (as text), key (XXH64 of the text), n_words, hits, items, near, merged over the blocks of the test side."""
    if span < size:
        raise ValueError("span must be at least size")
    ship(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    index = build_index(keyed)
    found = [search(index, side, span) for side in blocks(items, item_col, "text", size, block_words)]
    if len(found) == 1:
        return found[0]
    # rows that repeat both id and text find the same, so they are merged and then joined to each row again
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    merged = (
        reduce(DataFrame.unionByName, found)
        .withColumnsRenamed({"id": "i", "key": "k"})
        .groupBy("i", "k")
        .agg(F.max("n_words").alias("n_words"), union("hits"), union("items"), union("near"))
    )
    return keyed.drop("text").join(merged, F.col("id").eqNullSafe(F.col("i")) & F.col("key").eqNullSafe(F.col("k"))).drop("i", "k")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 10, block_words: int = 500_000, span: int = 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near and near_sha256 (items with proximity matches, phrases included)."""
    found = matches(docs, items, id_col, text_col, item_col, size, block_words, span)
    digest = lambda c: F.sha2(F.array_join(F.array_sort(c), ","), 256)
    return found.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
        digest("near").alias("near_sha256"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 10, block_words: int = 500_000) -> DataFrame:
    """The documents without any word inside an occurring window, with the columns of `docs`."""
    bad = matches(docs, items, id_col, text_col, item_col, size, block_words, max(size, 20)).filter(F.size("hits") > 0)
    bad = cut(bad.select(F.col("id").alias("__dc_id"), F.col("key").alias("__dc_key")).distinct())
    same = F.col(id_col).cast("string").eqNullSafe(F.col("__dc_id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__dc_key"))
    return docs.join(bad, same, "left_anti")


def proximity(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 10, slop: int = 20, block_words: int = 500_000) -> DataFrame:
    """(id, item) of every proximity match within a stretch of at most max(size, `slop`) words. An id that repeats is reported once for an item."""
    near = matches(docs, items, id_col, text_col, item_col, size, block_words, max(size, slop)).select("id", F.explode("near").alias("item")).distinct()
    return near.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("item").cast(items.schema[item_col].dataType).alias(item_col))
