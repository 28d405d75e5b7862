"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts are words (runs of letters and digits, lower-cased) and their five-word shingles. A license passage is a stretch of at most m + ceil(m / 2) - 1 words that holds
at least 0.8 of the shingles of a template of m words. Windows of a class are three blocks of s shingles, one at each block; a template belongs to the
least class whose windows hold the longest passage of it wherever it begins, 2 s + 1 shingles. Sizes s go up by a third or a half, so a window
has at most some 3.4 times the template's shingles, and one that holds a passage has a Jaccard similarity of 0.2 or more with the template: 64 bands of one row
each meet with probability 1 - 0.8**64 > 0.999999. Every window of every text is hashed; the bands alone retrieve. MinHash values of longer windows are minima of those of
shorter blocks, so a text is hashed once for all classes. The windows retrieved are verified by the exact containment of the template's shingles.

Verified windows say where to look; the passages are spans of the template's own shingles in them. Passages of one template are disjoint: as many as there can be,
of those the greatest containments, then the shortest.

Templates of fewer than five words are one shingle of their length. Null and blank texts have no windows and are reported without licenses; texts of any length are scanned
whole. Repeated rows, and rows with a null id, are each reported. Columns of the input other than id and text are not read, whatever their names. An empty template list or table
gives no matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.license_texts import HEADINGS, NOTICES, WHOLE, license_files, tag_templates
from velarium.llm.text_rules import ALNUM, ALNUM_BYTES, grouped, lower_text, words_of
from velarium.shared import ship

#: Notices of a sentence; `scan` takes headings, identifiers, and whole texts besides.
TEMPLATES = NOTICES
SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8


#: Sizes of blocks in shingles, each made of blocks of an earlier size: (size, made of, how many).
LADDER = [(1, 0, 1), (2, 1, 2), (3, 1, 3)] + [(s * 2**k, s * 2 ** (k - 1), 2) for k in range(1, 21) for s in (2, 3)]
EMPTY = np.uint32(0xFFFFFFFF)
#: A class of more templates is looked up by its values' low bits first.
FEW, LOW = 12, (1 << 12) - 1


def shingles(words: list[str], size: int = SHINGLE) -> list[tuple[str, ...]]:
    """The shingles of words; fewer words than a shingle are one, no words none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def longest_passage(m: int) -> int:
    return m + -(-m // 2) - 1


def block_size(m: int) -> int:
    """The class of a template of m words: the least block size s whose windows of three blocks hold any stretch of its longest passage's shingles."""
    span = longest_passage(m) - min(SHINGLE, m) + 1
    return next(s for s, _, _ in LADDER if 2 * s + 1 >= span)


class WordHashes:
    """A 64-bit hash of each word; one worker remembers them, in bounded memory."""

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.known = most, {}

    def of(self, words: pa.Array) -> np.ndarray:
        import xxhash

        if len(self.known) > self.most:
            self.known = {}
        found, known, digest = words.dictionary_encode(), self.known, xxhash.xxh64_intdigest
        values = [h if (h := known.get(w)) is not None else known.setdefault(w, digest(w.encode("utf-8"), 42)) for w in found.dictionary.to_pylist()]
        return np.array(values, dtype=np.uint64)[found.indices.to_numpy()]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of the `size` words from each place on, from the words' 64-bit hashes."""
    n = max(0, len(words) - size + 1)
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += words[k : k + n]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.minimum((x >> np.uint64(32)).astype(np.uint32), EMPTY - np.uint32(1))


class Templates:
    """Band tables of the templates' MinHash values, by shingle size and class."""

    def __init__(self, templates: list[tuple[str, str]], bands: int = BANDS, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, bands, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands, dtype=np.uint32)
        self.hashes = WordHashes()
        self.names, self.words, self.sets, self.own = [], [], [], []
        #: (shingle size, block size) -> template numbers
        self.classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for name, text in templates:
            words = ALNUM.findall(lower_text(text))
            if words:
                size = min(SHINGLE, len(words))
                self.classes[size, block_size(len(words))].append(len(self.names))
                self.names.append(name)
                self.words.append(len(words))
                self.sets.append(frozenset(shingles(words)))
                self.own.append(np.unique(shingle_hashes(self.hashes.of(pa.array(words)), size)))
        self.bands = {c: np.stack([self.permuted(self.own[k]).min(axis=1) for k in of]) for c, of in self.classes.items()}
        #: for each class of many templates, which low bits the values of each band have
        self.marks = {}
        for c, table in self.bands.items():
            if len(table) > FEW:
                self.marks[c] = np.zeros((bands, LOW + 1), bool)
                for row in table:
                    self.marks[c][np.arange(bands), row & np.uint32(LOW)] = True

    def permuted(self, hashes: np.ndarray) -> np.ndarray:
        """(bands, n) values; a place without a shingle stays the greatest value."""
        out = hashes * self.a[:, None]
        out += self.b[:, None]
        out[:, hashes == EMPTY] = EMPTY
        return out

    def met(self, c: tuple[int, int], window: np.ndarray) -> set[tuple[int, int]]:
        """(window, template of the class) of all that share a band's value."""
        table, pairs = self.bands[c], set()
        if c not in self.marks:
            for t, row in enumerate(table):
                same = window == row[:, None]
                if same.any():
                    pairs.update((i, t) for i in np.unique(np.nonzero(same)[1]).tolist())
            return pairs
        marked = self.marks[c][np.arange(len(window))[:, None], window & np.uint32(LOW)]
        band, at = np.nonzero(marked)
        for k in range(0, len(at), 10_000):
            i, t = np.nonzero(window[band[k : k + 10_000], at[k : k + 10_000]][:, None] == table[:, band[k : k + 10_000]].T)
            pairs.update(zip(at[k + i].tolist(), t.tolist(), strict=True))
        return pairs

    def retrieve(self, hashes: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """(template, first place, end place) of every window that meets a template in a band; EMPTY marks places without a shingle."""
        classes = {s: of for (g, s), of in self.classes.items() if g == size}
        need = set(classes)
        for s, made_of, _ in reversed(LADDER):
            if s in need and made_of:
                need.add(made_of)
        minima, out = {0: self.permuted(hashes)}, []
        for s, made_of, parts in LADDER:
            if s not in need:
                continue
            here = minima[made_of]
            if parts > 1:
                short = -here.shape[1] % parts
                low = np.pad(here, ((0, 0), (0, short)), constant_values=EMPTY) if short else here
                here = np.minimum(low[:, ::parts], low[:, 1::parts])
                if parts == 3:
                    np.minimum(here, low[:, 2::3], out=here)
            minima[s] = here
            if s in classes:
                # the window at block i is blocks i to i + 2
                window = here.copy()
                np.minimum(window[:, :-1], here[:, 1:], out=window[:, :-1])
                np.minimum(window[:, :-2], here[:, 2:], out=window[:, :-2])
                out += [(classes[s][t], i * s, (i + 3) * s) for i, t in sorted(self.met((size, s), window))]
        return out

    def scan_all(self, words: pa.Array, sizes: np.ndarray, least: float = CONTAINMENT) -> dict[int, list[tuple[str, int, int, float]]]:
        """Of texts laid end to end: text number -> (name, first word, end word, containment) of every license passage, in text order."""
        ends = np.cumsum(sizes)
        hashes, found = self.hashes.of(words), defaultdict(list)
        verified: dict[tuple[int, int], dict[int, tuple[str, ...]]] = defaultdict(dict)
        for size in sorted({g for g, _ in self.classes}):
            x = np.full(len(hashes), EMPTY, np.uint32)
            own = shingle_hashes(hashes, size)
            x[: len(own)] = own
            # a shingle lies in one text
            left = np.repeat(ends, sizes) - np.arange(len(hashes))
            x[left < size] = EMPTY
            for k, first, end in self.retrieve(x, size):
                likely = (first + np.flatnonzero(np.isin(x[first:end], self.own[k]))).tolist()
                there = {p: own for p in likely if (own := tuple(words[p : p + size].to_pylist())) in self.sets[k]}
                if len(set(there.values())) / len(self.sets[k]) >= least:
                    for p, own in there.items():
                        verified[int(np.searchsorted(ends, p, side="right")), k][p] = own
        for (d, k), at in verified.items():
            start, order = int(ends[d] - sizes[d]), sorted(at)
            found[d] += [(k, *p) for p in self.passages(k, [at[p] for p in order], [p - start for p in order], least)]
        return {d: [(self.names[k], a, b, c) for k, a, b, c in sorted(of, key=lambda x: (x[1], x[0]))] for d, of in found.items() if of}

    def scan(self, words: list[str], least: float = CONTAINMENT) -> list[tuple[str, int, int, float]]:
        """(name, first word, end word, containment) of every license passage in a text, in text order."""
        return self.scan_all(pa.array(words, pa.string()), np.array([len(words)]), least).get(0, []) if words else []

    def passages(self, k: int, own: list[tuple[str, ...]], at: list[int], least: float) -> list[tuple[int, int, float]]:
        """Disjoint (first word, end word, containment) of template k over its shingles and their starts."""
        m, total = self.words[k], len(self.sets[k])
        size, longest = min(SHINGLE, m), longest_passage(m)
        number = {w: i for i, w in enumerate(dict.fromkeys(own))}
        last, before = [-1] * len(number), np.zeros(len(own), np.int64)
        # the place before each at which its shingle stood
        for i, w in enumerate(own):
            before[i], last[number[w]] = last[number[w]], i
        starts = np.array(at, dtype=np.int64)
        ends = starts + size
        # the first place that a passage that ends here leaves free, and the last place that a passage from here may reach
        free, reach = np.searchsorted(starts, ends), np.searchsorted(ends, starts + longest, side="right")
        # from the right: passages, their shingles, minus their words, that begin at or after each start, and the span taken
        best = np.zeros((len(at) + 1, 3), np.int64)
        taken: list[tuple[int, int, float] | None] = [None] * len(at)
        follows = [0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            best[i] = best[i + 1]
            have = np.cumsum(before[i : reach[i]] < i)
            fit = np.flatnonzero(have / total >= least)
            if not len(fit):
                continue
            these = best[free[i + fit]] + np.stack([np.ones(len(fit), np.int64), have[fit], at[i] - ends[i + fit]], axis=1)
            # the greatest, the first of equal ones
            e = int(np.lexsort((-np.arange(len(fit)), these[:, 2], these[:, 1], these[:, 0]))[-1])
            if tuple(these[e]) > tuple(best[i]):
                end = int(ends[i + fit[e]])
                best[i], taken[i], follows[i] = these[e], (at[i], end, float(have[fit[e]] / total)), int(free[i + fit[e]])
        out, i = [], 0
        while i < len(at):
            span = taken[i]
            if span:
                out.append(span)
            i = follows[i] if span else i + 1
        return out


def every_template() -> list[tuple[str, str]]:
    """The default templates: notices, headings, identifiers and whole texts, 69 of at most 5,700 words."""
    return NOTICES + HEADINGS + tag_templates() + WHOLE + license_files()


FOUND = "key string, n_words long, matches array<struct<license:string,first_word:int,end_word:int,containment:double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """One row per input row: id, n_words, matches (license, first_word, end_word, containment)."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(every_template() if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = Templates(shipped.value), ("license", "first_word", "end_word", "containment")
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))
        for batch in grouped(batches, 1, 500_000):
            words, sizes = words_of(batch.column(1), ALNUM_BYTES)
            found = tables.scan_all(words, sizes, least)
            matches = pa.array([[dict(zip(names, m, strict=True)) for m in found.get(d, ())] for d in range(len(sizes))], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), matches], names=["key", "n_words", "matches"])

    out = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col)).mapInArrow(run, FOUND)
    return out.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "matches")


def licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: id, n_words, n_matches, licenses (distinct names, sorted, comma-joined), containment (the greatest, else 0)."""
    found = scan(docs, **options)
    ident = found.columns[0]
    return found.select(
        ident,
        "n_words",
        F.size("matches").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"),
    )
