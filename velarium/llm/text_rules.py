"""Text rules that several corpus operators share, for Spark columns and for Python tasks."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
TO_LOWER = str.maketrans(UPPER, LOWER)

#: Words between ASCII white space (space and U+0009 to U+000D).
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: Runs of ASCII letters and digits and of everything beyond ASCII, after lower-casing.
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def lower_text(s: str | None) -> str:
    """Lower-case A-Z only; null is the empty text."""
    if not s:
        return ""
    return s.lower() if s.isascii() else s.translate(TO_LOWER)


def fold(c: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (null ids count as the empty string)."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


#: The same two rules byte by byte: what parts words becomes a space, all of UTF-8 beyond ASCII stays.
SPACED_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
ALNUM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts end to end, and how many each text has; null has none."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = bytes(memoryview(data)[at[0] : at[-1]] if data else b"").translate(table)
    lowered = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(own))
    parts = pc.ascii_split_whitespace(lowered)
    words, cuts = parts.values, parts.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy() > 0
    if real.all():
        return words, np.diff(cuts).astype(np.int64)
    return words.filter(pa.array(real)), np.diff(np.r_[0, np.cumsum(real)][cuts])


def grouped(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of the text column; one longer text is a batch by itself."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size - n, side="right")))
            held.append(batch.slice(start, stop - start))
            n += int(ends[stop - 1]) - done
            start = stop
            if n >= size or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
