"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's emission scores sum the weights of its affixes, character n-grams and lexicon marks; learned transitions join neighbouring
words. Forward-backward gives each word's posterior; a text's language has the greatest mean posterior over its words.

Every language of the training fold is learned. The fit takes at most about `per_language` texts of each (chosen by hash), of each at most `piece_chars` characters from a place
chosen by hash, and `most_words` words, which the languages share evenly (what one doesn't need goes to the others); these bounds are parameters. Training sequences are spliced
from pieces of those texts, so that switches are seen. The model holds 32,768 weights a language, at the driver and in each task.
All words of whole texts are labelled, however long. Language, source and id are never inputs of a prediction.

Words are runs of letters (Unicode's category L); numerals of any kind and marks part words. A text that is null or has no letter is `und` with score 0, as is every
text if no language was learned, for instance from an empty table. Ties go to the language that sorts first. Repeated rows, and rows with a null id, are each reported;
equal texts get equal answers up to rounding. Columns of the input other than id, text and language are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velarium.llm.lanes import lanes_of
from velarium.llm.text_rules import fold
from velarium.shared import ship



def _letters(last: int) -> re.Pattern:
    """Runs of letters: word characters but the underscore and what is alphanumeric, up to the character `last`, without being a letter."""
    others, start = [], None
    for c in range(last + 2):
        other = c <= last and (x := chr(c)).isalnum() and not x.isalpha()
        if other and start is None:
            start = c
        elif not other and start is not None:
            others.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(r"[^\W_" + "".join(others) + "]+")


LETTERS, LETTERS_BELOW_ASTRAL = _letters(sys.maxunicode), _letters(0xFFFF)


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case. The pattern for texts without characters above U+FFFF is the faster one, as its class is a bitmap."""
    low = (text or "").lower()
    if low.isascii() or len(low.encode("utf-16-le", "surrogatepass")) == 2 * len(low):
        return LETTERS_BELOW_ASTRAL.findall(low)
    return LETTERS.findall(low)


WIDTH = 1 << 15
#: Distinct words whose emissions one worker remembers before it starts anew.
REMEMBERED = 300_000


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Feature numbers of a word: affixes, boundary-marked 2- and 3-grams, and the lexicon's languages, hashed."""
    crc = zlib.crc32
    b = word.encode("utf-8", "surrogatepass")
    marked = b"<" + b + b">"
    out = [crc(b"p" + b[:2]), crc(b"P" + b[:4]), crc(b"s" + b[-2:]), crc(b"S" + b[-4:])]
    out += [crc(marked[i : i + 2]) for i in range(len(marked) - 1)]
    out += [crc(marked[i : i + 3]) for i in range(len(marked) - 2)]
    marks = lexicon.get(word, 0)
    out.append(crc(b"lexicon%d" % marks))
    return [x & (WIDTH - 1) for x in out]


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (WIDTH, languages)
    switch: np.ndarray  # (languages, languages)
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [word_features(w, self.lexicon) for w in words]
        if not found:
            return np.zeros((0, len(self.languages)), np.float32)
        starts = np.r_[0, np.cumsum([len(f) for f in found])[:-1]]
        return np.add.reduceat(self.weights[np.concatenate([np.array(f) for f in found])], starts, axis=0)

    def posteriors(self, emissions: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over lanes: marginals (steps, lanes, languages), and scaled forward values for pair marginals."""
        steps, lanes, n = emissions.shape
        e = np.exp(emissions - emissions.max(2, keepdims=True))
        m = np.exp(self.switch - self.switch.max())
        ahead, back = np.empty_like(e), np.empty_like(e)
        a = np.ones((lanes, n), e.dtype)
        for t in range(steps):
            a = np.where(fresh[t][:, None], 1, a @ m) * e[t]
            a /= a.sum(1, keepdims=True)
            ahead[t] = a
        b = np.ones((lanes, n), e.dtype)
        for t in range(steps - 1, -1, -1):
            back[t] = b
            b = np.where(fresh[t][:, None], 1, (b * e[t]) @ m.T)
            b /= b.sum(1, keepdims=True)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        return p, ahead


def word_budgets(sizes: list[int], most: int) -> list[int]:
    """Even shares of `most` words; what a language has no words for is shared among the others."""
    out, left = [0] * len(sizes), most
    for done, k in enumerate(sorted(range(len(sizes)), key=lambda k: sizes[k])):
        out[k] = min(sizes[k], left // (len(sizes) - done))
        left -= out[k]
    return out


def fit(texts: list[tuple[str, str]], seed: int = 5, length: int = 48, epochs: int = 6, most_words: int = 250_000, rate: float = 0.3) -> Crf:
    """Train on (text, language) by adaptive gradients on the log likelihood of spliced sequences."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in texts})
    number = {lang: k for k, lang in enumerate(languages)}
    n = len(languages)
    pieces, seen = [], [Counter() for _ in languages]
    split = [(words_of(text), number[lang]) for text, lang in texts]
    for words, own in split:
        seen[own].update(words)
    left = word_budgets([c.total() for c in seen], most_words)
    for words, own in split:
        at = 0
        while at < len(words) and left[own] > 0:
            k = int(rng.integers(4, 40))
            pieces.append((words[at : at + k], own))
            left[own] -= len(words[at : at + k])
            at += k
    # the lexicon marks the languages in which a word is frequent for its number of occurrences
    lexicon: dict[str, int] = {}
    for w in {w for c in seen for w, k in c.items() if k >= 5}:
        share = np.array([c[w] / max(1, c.total()) for c in seen])
        lexicon[w] = sum(1 << k for k in range(n) if share[k] > 0.5 * share.max())
    crf = Crf(languages, np.zeros((WIDTH, n), np.float32), np.zeros((n, n), np.float32), lexicon)
    if n < 2 or not pieces:
        return crf
    order = rng.permutation(len(pieces))
    words = [w for k in order for w in pieces[k][0]]
    truth = np.array([pieces[k][1] for k in order for _ in pieces[k][0]])
    rows = len(words) // length
    if not rows:
        length, rows = len(words), 1
    words, truth = words[: rows * length], truth[: rows * length].reshape(rows, length)
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    of_word = [np.array(word_features(w, lexicon)) for w in distinct]
    ids = np.array([distinct[w] for w in words]).reshape(rows, length)
    g2w, g2s = np.full((WIDTH, n), 1e-2, np.float32), np.full((n, n), 1e-2, np.float32)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(rows), max(1, rows // 64)):
            own, y = ids[batch].ravel(), truth[batch]
            feats = [of_word[k] for k in own]
            sizes = np.array([len(f) for f in feats])
            flat = np.concatenate(feats)
            em = np.add.reduceat(crf.weights[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0).reshape(len(batch), length, n).transpose(1, 0, 2)
            fresh = np.zeros((length, len(batch)), bool)
            fresh[0] = True
            p, ahead = crf.posteriors(em, fresh)
            d = p.copy()
            d[np.arange(length)[:, None], np.arange(len(batch))[None, :], y.T] -= 1
            # pair marginals: forward value, transition, and what the next marginal has beyond its own forward prediction
            m = np.exp(crf.switch - crf.switch.max())
            predicted = np.maximum(ahead[:-1] @ m, 1e-12)
            pairs = np.einsum("tbi,tbj->ij", ahead[:-1], p[1:] / predicted) * m
            gs = pairs.astype(np.float32)
            np.subtract.at(gs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            per = np.repeat(d.transpose(1, 0, 2).reshape(-1, n), sizes, axis=0)
            gw = np.stack([np.bincount(flat, per[:, k], WIDTH) for k in range(n)], axis=1).astype(np.float32) / len(own)
            gs /= len(own)
            gw += 1e-6 * crf.weights
            g2w += gw * gw * 1e4
            g2s += gs * gs * 1e4
            crf.weights -= rate * gw * 100 / np.sqrt(g2w)
            crf.switch -= rate * gs * 100 / np.sqrt(g2s)
    return crf


class Labeller:
    """Emissions of distinct words are kept in one worker, in bounded memory."""

    def __init__(self, crf: Crf) -> None:
        self.crf, self.number, self.table = crf, {}, np.zeros((0, len(crf.languages)), np.float32)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self.number, self.table = {}, self.table[:0]
        number = self.number
        out = [np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32) for words in texts]
        if len(number) > len(self.table):
            fresh = list(number)[len(self.table) :]
            parts = [self.crf.emissions(fresh[k : k + 20_000]) for k in range(0, len(fresh), 20_000)]
            self.table = np.concatenate([self.table, *parts])
        return out

    def posteriors(self, texts: list[list[str]], lanes: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(owner, marginals) over the laid-out words, as flat arrays in text order within a lane."""
        ids = self.ids(texts)
        symbols, owner = lanes_of(ids, max(1, min(lanes, len(ids))))
        if not len(symbols):
            return np.zeros(0, np.int32), np.zeros((0, len(self.crf.languages)))
        fresh = np.ones(owner.shape, bool)
        fresh[1:] = owner[1:] != owner[:-1]
        p, _ = self.crf.posteriors(self.table[symbols], fresh)
        return owner.T.ravel(), p.transpose(1, 0, 2).reshape(-1, p.shape[2])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, per_language: int = 150, piece_chars: int = 20_000) -> Crf:
    learn = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull() & (fold(F.col("i"), modulus) != held_out)
    )
    # a row a language: the tasks of a prediction hold far more of each
    counts = learn.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64(F.lit("crf"), F.col("i"), F.col("t")), F.lit(1 << 30))
    drawn = learn.join(F.broadcast(counts), "l").withColumn("h", place).filter(F.col("h") < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")))
    # a language may be drawn more often than it should; the first by place stay
    first = drawn.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("k") <= 2 * per_language)
    start = 1 + F.pmod(F.col("h"), F.greatest(F.length("t") - piece_chars, F.lit(0)) + 1).cast("int")
    sample = first.select(F.substring("t", start, F.lit(piece_chars)).alias("t"), "l", "h").collect()
    return fit([(r["t"], r["l"]) for r in sorted(sample, key=lambda r: (r["h"], r["l"], r["t"]))])


def _grouped(batches: Iterator[pa.RecordBatch], words: int = 500_000) -> Iterator[tuple[list, list[list[str]]]]:
    keys, texts, n = [], [], 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys.append(k)
            texts.append(words_of(t.as_py()))
            n += len(texts[-1])
            if n >= words:
                yield keys, texts
                keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (mean posterior of that language over the text's words)."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shipped.value
        own, n = Labeller(crf), len(crf.languages)
        for keys, texts in _grouped(batches):
            if n:
                owner, p = own.posteriors(texts)
                real = owner >= 0
                owner, p = owner[real], p[real]
                mean = np.stack([np.bincount(owner, p[:, k], len(texts)) for k in range(n)], axis=1).astype(np.float64)
                mean /= np.maximum(1, np.array([len(t) for t in texts]))[:, None]
                best = mean.argmax(1)
                names = [crf.languages[b] if t else "und" for b, t in zip(best, texts, strict=True)]
                scores = np.clip(mean[np.arange(len(texts)), best], 0, 1)
            else:
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["key", "lang_pred", "score"])

    found = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col)).mapInArrow(run, "key string, lang_pred string, score double")
    return found.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "lang_pred", "score")


def label_words(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, words, labels (the likeliest language of each word by its posterior)."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shipped.value
        own = Labeller(crf)
        for keys, texts in _grouped(batches):
            labels: list[list[str]] = [[] for _ in texts]
            if crf.languages:
                owner, p = own.posteriors(texts)
                for d, k in zip(owner.tolist(), p.argmax(1).tolist(), strict=True):
                    if d >= 0:
                        labels[d].append(crf.languages[k])
            else:
                labels = [["und"] * len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))], names=["key", "words", "labels"])

    found = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col)).mapInArrow(run, "key string, words array<string>, labels array<string>")
    return found.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "words", "labels")
