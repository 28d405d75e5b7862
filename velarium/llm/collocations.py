"""Phrase collocations by merged count-min sketches and an exact second pass.

First pass: every task counts the hashes of all phrases of one to four words in a count-min sketch; cells saturate at `least`, which changes no answer to "at least `least`?" The
tasks' sketches are cut in stripes, added stripe by stripe in Spark, and each cell becomes one bit: reached or not. A sketch overestimates, so no frequent phrase is lost.

Second pass: phrases whose cells are reached in every row of the sketch, and whose first and last words up to one less survive too, are counted exactly: in each task by their words (not their
hashes), then by an aggregation in Spark on language and phrase. False survivors end there. Cuts, scores and subsumption are joins on phrases.

The sketch has about a cell for each `per_cell` bytes of text, between `cells[0]` and `cells[1]` in each of its two rows, and there are as many sketches as `sketches` says, two a core of the
cluster by default. Where the text asks for more than four times `cells[1]`, one sketch would let nearly all phrases through, as a cell that many rare phrases share reaches `least` by them alone. Then words
and pairs are sketched first, and longer phrases in a second pass only where all of their pairs are reached, which leaves few. Both of these sketches grow with the text, a cell for
`8 * per_cell` and `32 * per_cell` bytes, up to `MOST` cells a row (their bits go to all tasks: an eighth of the cells in bytes): a task holds no sketch but sends the cells it
counted, so its memory doesn't grow. Beyond that (some 17 GB of text) more phrases survive to the exact pass; the results are the same at any size.

Null texts are empty, null languages `und`. Texts of any length are read whole, in stretches of `STRETCH` words that overlap by three. Repeated rows are counted each. An empty table gives an
empty result. Columns other than text and language are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.llm.text_rules import grouped
from velarium.shared import ship, stored

LONGEST, ROWS, STRIPE, STRETCH, BATCH = 4, 2, 1 << 20, 1 << 17, 3_000_000
#: Cells of a row of a sketch in pieces, and how many counted cells a task holds before it sends them.
MOST, HELD = 1 << 28, 1 << 22
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cased, all that parts words a space; and what kind each byte is: part of a word, blank, end of a piece.
_SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _BREAKS or c == 9 else c for c in range(256))
_KIND = np.array([2 if c in _BREAKS else 1 if c in (9, 32) else 0 for c in range(256)], np.uint8)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of a batch end to end: text, dictionary code, language, and how many words follow in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        _, ends, data = texts.buffers()
        at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = bytes(memoryview(data)[at[0] : at[-1]]) if data else b""
        at = (at - at[0]).astype(np.int64)
        lowered = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.translate(_SPACED)))
        words = pc.ascii_split_whitespace(lowered).values
        self.words = words.filter(pc.greater(pc.binary_length(words), 0))
        kind = _KIND[np.frombuffer(raw, np.uint8)]
        first = kind == 0
        first[1:] &= (kind[:-1] != 0) | _heads(at, len(kind))[1:]
        starts = np.flatnonzero(first)
        piece = np.cumsum(kind == 2)[starts]
        owner = np.searchsorted(at, starts, side="right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
        begins = np.flatnonzero(new)
        stops = np.append(begins, len(starts))[1:]
        self.left = np.repeat(stops, stops - begins) - np.arange(len(starts))
        coded = self.words.dictionary_encode()
        self.code, self.types = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        named = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = named.dictionary
        self.lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        if len(self.words) != len(starts):
            raise AssertionError("words and their places differ")

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word and of each word's language."""
        return _hash(self.types)[self.code], _hash(self.langs)[self.lang]


def _heads(at: np.ndarray, size: int) -> np.ndarray:
    """Marks the first byte of each text."""
    out = np.zeros(size, bool)
    out[at[:-1][at[:-1] < size]] = True
    return out


def _hash(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: its bytes as a polynomial, then mixed."""
    if not len(values):
        return np.zeros(0, np.uint64)
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw, at = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]
    sizes = np.diff(at)
    powers = np.multiply.accumulate(np.full(sizes.max() + 1, _MIX[0]))
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(at[:-1], sizes)])]
    h = sums[at[1:]] - sums[at[:-1]]
    for shift, factor in ((np.uint64(32), _MIX[1]), (np.uint64(29), _MIX[0])):
        h = (h ^ (h >> shift)) * factor
    return h ^ (h >> np.uint64(32))


def phrase_hashes(word: np.ndarray, lang: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the phrase of that length at each word); the last words have none of the greater lengths."""
    h = lang
    for k in range(LONGEST):
        h = (h[: len(word) - k] ^ word[k:]) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
        yield k + 1, h


def cells_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in the two rows of the sketch."""
    low = np.uint32((1 << bits) - 1)
    return (h.astype(np.uint32) & low), ((h >> np.uint64(32)).astype(np.uint32) & low)


def sketch_bits(size: int, per_cell: int, cells: tuple[int, int]) -> int:
    return int(np.clip(size // per_cell, *cells)).bit_length() - 1


def _stretches(words: Words) -> Iterator[tuple[slice, int]]:
    """(words of a stretch and the three after it, how many phrases start in it)."""
    n = len(words.code)
    for s in range(0, n, STRETCH):
        yield slice(s, min(n, s + STRETCH + LONGEST - 1)), min(STRETCH, n - s)


def _hashes(words: Words, word: np.ndarray, lang: np.ndarray, part: slice, n: int, lengths: tuple[int, ...], pairs: tuple[np.ndarray, int] | None) -> np.ndarray:
    """Hashes of the phrases of these lengths that start in a stretch; of the longer ones those all of whose pairs `pairs` (bits of a sketch) has."""
    found, alive = [], None
    for k, h in phrase_hashes(word[part], lang[part]):
        fits = words.left[part][: len(h)] >= k
        if pairs is not None and k == 2:
            a, b = cells_of(h, pairs[1])
            alive = fits & _reached(pairs[0][0], a) & _reached(pairs[0][1], b)
        for j in range(k - 1 if alive is not None and k > 2 else 0):
            fits &= alive[j : j + len(h)]
        if k in lengths:
            found.append(h[:n][fits[:n]])
    return np.concatenate(found)


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Cells in order and their counts: gaps byte by byte, as the upper bytes are mostly zero, then counts."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(gaps.tobytes() + n.tobytes(), "zstd", asbytes=True)


def _unpacked(size: int, blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 5 * size, "zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw[: 4 * size].reshape(4, size).T).view("<u4").ravel(), dtype=np.int64), raw[4 * size :]


def sketch(docs: DataFrame, text_col: Column, lang_col: Column, least: int, bits: int, sketches: int | None, lengths: tuple[int, ...] = tuple(range(1, LONGEST + 1)), pairs=None) -> np.ndarray:
    """The merged sketch as bits (rows, cells / 8): whether a cell reached `least`.

    It counts phrases of `lengths`; with `pairs`, a broadcast sketch and its bits, longer ones only where all of their pairs are reached. A task holds a sketch, or, where `sketches` is none, sends what it
    counted in pieces: sorted cells and their counts.
    """
    if not 0 < least < 256:
        raise ValueError("least: 1 to 255")
    cells, whole = 1 << bits, sketches is not None
    stripe = min(STRIPE if whole else max(1 << 18, cells >> 9), cells)
    per_row = cells // stripe

    def row(stripe: int, size: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([size], pa.int32()), pa.array([blob], pa.binary())], names=["stripe", "size", "cells"])

    def counted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at.sort()
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        return at[first], np.minimum(least, np.diff(np.r_[first, len(at)])).astype(np.uint8)

    def pieces(waiting: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for r, held in enumerate(waiting):
            at, n = counted(np.concatenate(held))
            edges = np.searchsorted(at, np.arange(per_row + 1, dtype=np.int64) * stripe).tolist()
            for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    yield row(r * per_row + s, b - a, _packed(at[a:b] - np.uint32(s * stripe), n[a:b]))
            held.clear()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((ROWS, cells if whole else 0), np.uint8)
        waiting, size, known = [[] for _ in range(ROWS)], 0, pairs.value if pairs is not None else None
        for batch in grouped(batches, 0, BATCH):
            words = Words(batch.column(0), batch.column(1))
            word, lang = words.hashes()
            for part, n in _stretches(words):
                found = cells_of(_hashes(words, word, lang, part, n, lengths, known), bits)
                if whole:
                    for own, at in zip(held, found, strict=True):
                        where, times = counted(at)
                        own[where] = np.minimum(least, own[where].astype(np.int64) + times)
                    continue
                size += len(found[0])
                for own, at in zip(waiting, found, strict=True):
                    own.append(at)
                if size >= HELD:
                    yield from pieces(waiting)
                    size = 0
        if size:
            yield from pieces(waiting)
        for r in range(ROWS if whole else 0):
            for s in range(per_row):
                own = held[r, s * stripe : (s + 1) * stripe]
                if own.any():
                    yield row(r * per_row + s, -1, pa.compress(own.tobytes(), "zstd", asbytes=True))

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(stripe, np.uint8)
        for batch in batches:
            for size, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if size < 0:
                    total = np.minimum(least, total.astype(np.uint16) + np.frombuffer(pa.decompress(own.as_buffer(), stripe, "zstd"), np.uint8)).astype(np.uint8)
                else:
                    where, n = _unpacked(size, own.as_buffer())
                    total[where] = np.minimum(least, total[where].astype(np.uint16) + n)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["stripe", "bits"])

    texts = docs.select(text_col.alias("t"), lang_col.alias("l"))
    parts = (texts.coalesce(sketches) if whole else texts).mapInArrow(tally, "stripe int, size int, cells binary")
    out = np.zeros((ROWS * per_row, stripe // 8), np.uint8)
    for r in parts.groupBy("stripe").applyInArrow(merge, "stripe int, bits binary").collect():
        out[r["stripe"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(ROWS, cells // 8)


def _reached(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, per_cell: int = 8, cells: tuple[int, int] = (1 << 20, 1 << 25), sketches: int | None = None) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to 4 words with f >= least, and of each language a row with words = 0 and f all its word occurrences."""
    spark = docs.sparkSession
    ship(spark)
    text, lang = F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    if size // (4 * per_cell) <= cells[1]:
        bits = sketch_bits(size, per_cell, cells)
        low = high = spark.sparkContext.broadcast((sketch(docs, text, lang, least, bits, sketches or 2 * spark.sparkContext.defaultParallelism), bits))
    else:
        bits = sketch_bits(size, 8 * per_cell, (cells[0], MOST))
        low = spark.sparkContext.broadcast((sketch(docs, text, lang, least, bits, None, (1, 2)), bits))
        bits = max(3, bits - 2)
        high = spark.sparkContext.broadcast((sketch(docs, text, lang, least, bits, None, tuple(range(3, LONGEST + 1)), low), bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 0, BATCH):
            words = Words(batch.column(0), batch.column(1))
            word, lang = words.hashes()
            totals = np.bincount(words.lang, minlength=len(words.langs))
            yield _counted(words.langs, pa.array([""] * len(words.langs), pa.string()), 0, totals)
            for part, n in _stretches(words):
                code, own, left = words.code[part], words.lang[part], words.left[part]
                ids, alive = own * len(words.types) + code, np.ones(len(code), bool)
                for k, h in phrase_hashes(word[part], lang[part]):
                    m = len(h)
                    fits = alive[:m] & (left[:m] >= k)
                    if k > 1:  # the phrase without its first word survives too
                        fits &= alive[1 : m + 1]
                    at = np.flatnonzero(fits)
                    rows, bits = (low if k < 3 else high).value
                    a, b = cells_of(h[at], bits)
                    at = at[_reached(rows[0], a) & _reached(rows[1], b)]
                    key = ids[at] if k == 1 else ids[at] * len(words.types) + code[at + k - 1]
                    kinds, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                    alive, ids = np.zeros(m, bool), np.zeros(m, np.int64)
                    alive[at], ids[at] = True, inverse
                    mine = at < n  # phrases that start in the overlap belong to the next stretch
                    f = np.bincount(inverse[mine], minlength=len(kinds))
                    start = at[first][f > 0]
                    phrase = words.words.take(pa.array(part.start + start))
                    for j in range(1, k):
                        phrase = pc.binary_join_element_wise(phrase, words.words.take(pa.array(part.start + start + j)), " ")
                    yield _counted(words.langs.take(pa.array(own[start])), phrase, k, f[f > 0])

    parts = docs.select(text.alias("t"), lang.alias("l")).mapInArrow(count, "lang string, phrase string, words int, f long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))


def _counted(langs: pa.Array, phrases: pa.Array, k: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(np.full(len(f), k, np.int32)), pa.array(f.astype(np.int64))], names=["lang", "phrase", "words", "f"])


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.col("w"), first, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, scale: int = 2_000_000, cover: int = 80, top: int | None = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases that no longer candidate covers to `cover` percent; the first `top` of each language, or all."""
    counts = stored(phrase_counts(docs, text_col, lang_col, least, **options), "phrase-counts")
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    chosen = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = chosen.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = lambda c: f"cast({c} as decimal(20,0))"
    score = F.expr(f"({whole('a')} * {whole(scale)}) div ({whole('l')} + {whole('r')})")
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # of each phrase the most frequent longer candidate that holds it
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    longer = chosen.filter("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    free = scored.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"held is null or {whole('held')} * 100 < {whole('a')} * {cover}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")))
    if top is not None:
        free = free.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    else:
        free = free.withColumn("rank", F.lit(None).cast("long"))
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return free.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
