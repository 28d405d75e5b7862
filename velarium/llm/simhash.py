"""SimHash near-deduplication by fuzzy hashing with the binary Golay code.

A fingerprint's 64 bits make three segments of 21, 21 and 22 bits, padded to the 23 bits of the perfect Golay code, in
which every word lies within three bits of exactly one codeword. A word and its neighbours at one bit decode to at most some six
codewords, its near indices. If two fingerprints differ in at most three bits, the segments' errors fall in one of two ways:

* no segment holds more than one: each segment's index is near the other's. One side goes under the near indices of the first two
  segments and its own of the third, the other under its own of the first two and the near ones of the third (36 bits);
* one segment holds two or three: of the other two one is equal and the other within one bit. Both go under the equal segment's bits, one side with
  its own index of the other segment, the other side with the near ones (33 or 34 bits), for each choice of the two segments.

So linked fingerprints always meet under a key, and a key is long enough that few others do. Candidates are verified by the bit count of their XOR.
Where more than `bucket` fingerprints are stored under one key, their pairs are not formed. Those fingerprints are put to every point of the
Hamming space within two bits of them instead, and at each point linked to the least fingerprint within one bit of it: those are true links, two fingerprints
within three bits share such a point, and a point has at most 2,081 fingerprints around it. The links then are fewer, their components the same.

Copies share a fingerprint, so keys are made for distinct fingerprints alone, and documents follow by their fingerprint.
Components of the links come from alternating star contraction in Spark.

A null or blank text has no shingles and fingerprint zero, linked like any other; a text of one or two words is one shingle; texts of any length are
read whole. Repeated rows each get their component. Null ids never become a component's id unless the component has no other. Columns of the input
other than id and text are not read by `near_duplicates` and are kept by `deduplicate`, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.components import components
from velarium.shared import cut, ship, stored

SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: The segment that is equal and the one within a bit, where the third holds the other errors.
EQUAL_NEAR = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: Generator polynomial of the [23, 12, 7] Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the word shingles, repeats included, as an unsigned integer."""
    import xxhash

    from velarium.llm.text_rules import lower_text

    words = lower_text(text).encode("utf-8", "surrogatepass").split()  # bytes.split() parts at space and 09 to 0D
    if not words:
        return 0
    joined, n = memoryview(b" ".join(words)), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if n > shingle:
        ends, starts = ends[shingle - 1 :], starts[: n - shingle + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int = 3):
    """An Arrow function: text to the fingerprint as a signed 64-bit integer."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def simhash(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, shingle) for x in text.to_pylist()], dtype=np.uint64).view(np.int64))

    return simhash


class Golay:
    """Decoding of 23-bit words to 12-bit indices of their nearest codeword, by syndromes."""

    def __init__(self) -> None:
        rest = [0] * 256
        self.parts = []
        for shift in (0, 8, 16):
            rest = [self._remainder(v << shift) for v in range(256 if shift < 16 else 128)]
            self.parts.append(np.array(rest, dtype=np.int32))
        self.error = np.zeros(2048, dtype=np.int32)
        single = [1 << b for b in range(23)]
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    e = single[a] | single[b] | single[c]
                    self.error[self._remainder(e)] = e
        self.error[0] = 0

    @staticmethod
    def _remainder(v: int) -> int:
        while v.bit_length() > 11:
            v ^= GENERATOR << (v.bit_length() - 12)
        return v

    def index(self, words: np.ndarray) -> np.ndarray:
        """The codeword is the word less the error of its syndrome; its upper 12 bits number it."""
        syndrome = self.parts[0][words & 255] ^ self.parts[1][(words >> 8) & 255] ^ self.parts[2][words >> 16]
        return (words ^ self.error[syndrome]) >> 11

    def near(self, words: np.ndarray, bits: int) -> list[np.ndarray]:
        """Of each word the distinct indices of itself and its neighbours at one of the lower `bits`; its own comes first."""
        all_of = np.stack([self.index(words)] + [self.index(words ^ (1 << b)) for b in range(bits)], axis=1)
        rest = np.sort(all_of, axis=1)
        keep = np.ones(rest.shape, dtype=bool)
        keep[:, 1:] = rest[:, 1:] != rest[:, :-1]
        keep &= rest != all_of[:, :1]
        return [np.r_[own, row[k]] for own, row, k in zip(all_of[:, 0], rest, keep, strict=True)]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            u = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            words = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            near = [[x.astype(np.int64) for x in code.near(w.astype(np.int32), n)] for w, (_, n) in zip(words, SEGMENTS, strict=True)]
            stored_keys, probes = [], []
            for r in range(len(u)):
                n0, n1, n2 = near[0][r], near[1][r], near[2][r]
                held = [(n0[0] << 24) + (n1[0] << 12) + n2]
                asked = [((n0[:, None] << 24) + (n1[None, :] << 12) + n2[0]).ravel()]
                for tag, (same, close) in enumerate(EQUAL_NEAR, 1):
                    keys = (tag << 40) + (words[same][r] << 12) + near[close][r]
                    held.append(keys[:1])
                    asked.append(keys)
                stored_keys.append(np.concatenate(held))
                probes.append(np.concatenate(asked))
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(stored_keys), _lists(probes)], names=["fp", "stored", "probes"])


def _ball_links(prints: DataFrame, most: int) -> DataFrame:
    """True links (a, b) of the fingerprints fp whose components are those of all their links, by the points around each."""
    inner, outer = most // 2, most - most // 2
    masks = sorted((sum(1 << b for b in bits) for size in range(outer + 1) for bits in combinations(range(64), size)), key=int.bit_count)
    flips, close = np.array(masks, dtype=np.uint64), np.array([m.bit_count() <= inner for m in masks])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                fp = batch.column(0).slice(k, 50).to_numpy(zero_copy_only=False).astype(np.int64)
                points = (fp.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(fp, len(flips))), pa.array(np.tile(close, len(fp)))], names=["point", "fp", "close"])

    points = prints.select("fp").mapInArrow(around, "point long, fp long, close boolean")
    least = points.filter("close").groupBy("point").agg(F.min("fp").alias("least"))
    return points.join(least, "point").filter("fp <> least").select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b")).distinct()


def links(prints: DataFrame, most: int = 3, bucket: int = 2000) -> DataFrame:
    """Pairs a < b of the distinct values of column fp that differ in at most `most` (up to 3) bits.

    All of them, unless a key has more than `bucket` fingerprints: of those as many links as leave the components the same.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys are complete for up to 3 differing bits")
    ship(prints.sparkSession)
    keyed = stored(prints.select("fp").mapInArrow(_keys, "fp long, stored array<long>, probes array<long>"), "golay-keys")
    left = keyed.select(F.col("fp").alias("a"), F.explode("probes").alias("key"))
    right = keyed.select(F.col("fp").alias("b"), F.explode("stored").alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    hot = cut(right.groupBy("key").count().filter(F.col("count") > bucket).select("key"))
    crowded = not hot.isEmpty()
    few = right.join(hot, "key", "left_anti") if crowded else right
    found = left.join(few, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    if not crowded:
        return found
    dense = left.withColumnRenamed("a", "fp").unionByName(right.withColumnRenamed("b", "fp")).join(hot, "key", "left_semi").select("fp").distinct()
    return found.unionByName(_ball_links(cut(dense), most)).distinct()


def groups(prints: DataFrame, most: int = 3, bucket: int = 2000) -> DataFrame:
    """Of a table (id, fp), one row per distinct fingerprint: fp, component_id (smallest id reachable)."""
    firsts = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    joined = components(cut(links(firsts, most, bucket)))
    tied = firsts.join(joined.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
    roots = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = tied.join(roots, "root").select("fp", "component_id")
    return firsts.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    ship(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(shingle)(F.col(text_col)).alias("fp")))
    found = cut(groups(prints, most))
    # fingerprints of over 0.1 % of the rows (at most 1000) meet their component map-side, the others by a shuffle
    often = prints.groupBy("fp").count().filter(F.col("count") > 0.001 * prints.count()).select("fp")
    hot = cut(found.join(F.broadcast(often), "fp"))
    here = prints.join(F.broadcast(hot), "fp")
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(found, "fp")
    out = here.unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row of each component stays, one with its smallest id; the columns of `docs` are kept.

    The documents are written once with their fingerprints, so that the text is hashed once and a row's number is fixed.
    Only fingerprints of more than one row or of a linked component join back, others stay as they are.
    """
    ship(docs.sparkSession)
    fp, row, rep = "__sh_fp", "__sh_row", "__sh_rep"
    held = stored(docs.withColumn(fp, fingerprint_column(shingle)(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    prints = cut(held.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row")))
    # the smallest id first, null last, then the smallest row number
    best = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("row"))).alias("best")
    firsts = cut(prints.groupBy("fp").agg(best, F.count(F.lit(1)).alias("n")))
    joined = components(cut(links(firsts, most)))
    tied = firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    busy = tied.groupBy("root").agg(F.min("best").alias("top"), F.sum("n").alias("rows")).filter("rows > 1")
    marked = tied.join(busy, "root").select(F.col("fp").alias(fp), F.col("top.row").alias(rep))
    out = held.join(marked, fp, "left").filter(F.col(rep).isNull() | (F.col(rep) == F.col(row)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
