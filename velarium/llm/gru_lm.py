"""LM scoring by a gated recurrent language model (update and reset gates), trained here in numpy.

Words are counted over all training documents in Spark. The model's symbols are the most frequent words, the end of a text, and
buckets of the other words by their last two characters; a class-factored softmax (class, then member) gives a symbol's probability, and
inside a bucket a word has (c + 1) / (sum of (c + 1) of the bucket's words + 1), the last 1 standing for unseen words. So the model's
probability of a text is that of its symbols times that of its rarer words given their buckets.

Weights start from truncated backpropagation over a bounded seed sample (`seed_tokens`, a parameter), and are then refined on all
training documents, partition by partition, and averaged (see `fit_encoded` for what the split of the input changes: the score, never the base columns).
Texts of any length are scored in windows with the state carried over, from a zero state at the start of each.

The head, at most `head` words by count, none of them above 100 characters, goes to the tasks; the counts of other words are joined by a
shuffle. Null is the empty text (its end alone). Repeated rows are scored each. Columns of the input other than id and text are not read, whatever
their names. With no training documents every base score is 0 and words have the buckets' probability; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.lanes import lanes_of
from velarium.llm.text_rules import SPACED_BYTES, fold, grouped, words_of
from velarium.shared import ship, stored

HIDDEN, CLASSES, MEMBERS, BUCKETS = 32, 32, 32, 128
SYMBOLS = CLASSES * MEMBERS


class Gru:
    """A gated recurrent unit and its output layer: weights as one flat vector with named views.

    `inputs` gives the input part of update gate, reset gate and candidate, a column for each symbol (`table` is a view with rows for symbols), `u` the part of the state before; `cw` and `ww` hold a
    row for each class and member, the last column the bias.
    """

    SHAPES = {"inputs": (3 * HIDDEN, SYMBOLS), "u": (3 * HIDDEN, HIDDEN), "cw": (CLASSES, HIDDEN + 1), "ww": (CLASSES, MEMBERS, HIDDEN + 1)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self.table = self.inputs.T

    @classmethod
    def start(cls, frequency: np.ndarray, seed: int = 11) -> Gru:
        """Small random weights; output biases from the symbols' frequencies."""
        model = cls((np.random.default_rng(seed).normal(size=cls.SIZE) * 0.08).astype(np.float32))
        share = (frequency + 0.1).reshape(CLASSES, MEMBERS)
        model.cw[:, HIDDEN] = np.log(share.sum(1) / share.sum())
        model.ww[:, :, HIDDEN] = np.log(share / share.sum(1, keepdims=True))
        return model

    def states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states (steps, lanes, HIDDEN) and the last one; `fresh` marks where a text starts from zero.

        With s(x) = x / (1 + |x|): gates are (1 + s) / 2, the candidate is s of its input part and the reset gate's share of the state's part, and the state moves to the candidate by the update gate's
        share. In memory the steps and lanes of one component lie together, here and in the other methods, so that gates and candidate are contiguous blocks.
        """
        steps, lanes = inputs.shape
        both, one, half = 2 * HIDDEN, np.float32(1), np.float32(0.5)
        out, h = np.empty((HIDDEN, steps, lanes), np.float32), np.ascontiguousarray(h.T)
        x, q, w, starts = np.empty((3 * HIDDEN, lanes), np.float32), np.empty((both, lanes), np.float32), np.empty((both, lanes), np.float32), fresh.any(1)
        for t in range(steps):
            if starts[t]:
                h = np.where(fresh[t], np.float32(0), h)
            np.take(self.inputs, inputs[t], axis=1, out=x, mode="clip")
            a = self.u @ h
            g, own = a[:both], a[both:]
            g += x[:both]
            np.abs(g, out=q)
            q += one
            g /= q
            np.multiply(g, half, out=w)
            w += half
            n = w[HIDDEN:] * own
            n += x[both:]
            np.abs(n, out=q[:HIDDEN])
            q[:HIDDEN] += one
            n /= q[:HIDDEN]
            if keep is not None:
                keep.append((h, a, n))
            step = n - h
            step *= w[:HIDDEN]
            step += h
            h = out[:, t] = step
        return out.transpose(1, 2, 0), np.ascontiguousarray(h.T)

    def log_probs(self, h: np.ndarray, targets: np.ndarray, grads: Gru | None = None, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of the targets given states (n, HIDDEN); with `grads` also the states' gradient, each target counting `weight`."""
        order = np.argsort((targets // MEMBERS).astype(np.uint8), kind="stable")
        goal = targets[order]
        hs = np.empty((HIDDEN + 1, len(order)), np.float32)
        np.take(h.T, order, axis=1, out=hs[:HIDDEN], mode="clip")
        hs[HIDDEN] = 1  # the last row carries the biases
        group, member, rows = goal // MEMBERS, goal % MEMBERS, np.arange(len(goal))
        ends = np.searchsorted(group, np.arange(CLASSES + 1))
        ones, weight = np.ones(MEMBERS, np.float32), np.float32(weight)
        # states lie in (-1, 1), so this bounds every logit; below it, exponentials and their products need no shift
        far = max(np.abs(self.cw).sum(-1).max(), np.abs(self.ww).sum(-1).max()) > 40
        total, sums = np.zeros(len(goal), np.float32), np.ones(len(goal), np.float32)
        dh = None if grads is None else np.empty((HIDDEN, len(goal)), np.float32)

        def softmax(w: np.ndarray, part: slice, pick: np.ndarray, gw: np.ndarray | None, first: bool) -> None:
            """Add to the targets' logits and multiply the sums of exponentials for one softmax over `part`; the same for gradients."""
            x, at = hs[:, part], rows[: len(pick)]
            e = w @ x
            if far:
                e -= e.max(0)
            total[part] += e[pick, at]
            np.exp(e, out=e)
            s = ones @ e
            sums[part] *= s
            if gw is not None:
                e *= weight / s
                e[pick, at] -= weight
                gw += e @ x.T
                if first:
                    np.matmul(w[:, :HIDDEN].T, e, out=dh)
                else:
                    dh[:, part] += w[:, :HIDDEN].T @ e

        softmax(self.cw, slice(0, len(goal)), group, grads and grads.cw, True)
        for c in range(CLASSES):
            part = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                softmax(self.ww[c], part, member[part], grads and grads.ww[c], False)
        out = np.empty(len(targets))
        out[order] = total.astype(np.float64) - np.log(sums.astype(np.float64))
        if dh is None:
            return out, None
        back = np.empty(len(order), order.dtype)
        back[order] = rows
        return out, dh.take(back, axis=1).T

    def backward(self, inputs: np.ndarray, fresh: np.ndarray, kept: list, dout: np.ndarray, grads: Gru) -> None:
        """Backpropagation through one window; nothing flows further back than its first step."""
        steps, lanes = inputs.shape
        starts, both, one, half = fresh.any(1), 2 * HIDDEN, np.float32(1), np.float32(0.5)
        given, back = dout.transpose(2, 0, 1), np.ascontiguousarray(self.u.T)
        dx = np.empty((steps, lanes, 3 * HIDDEN), np.float32)  # a row for each input, so that rows of a symbol are moved whole
        dh, da = np.zeros((HIDDEN, lanes), np.float32), np.empty((3 * HIDDEN, lanes), np.float32)
        slope, w, dn = np.empty((both, lanes), np.float32), np.empty((both, lanes), np.float32), np.empty((HIDDEN, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h, a, n = kept[t]
            g, own = a[:both], a[both:]
            dh += given[:, t]
            np.multiply(g, half, out=w)
            w += half
            np.multiply(dh, w[:HIDDEN], out=dn)
            np.subtract(n, h, out=da[:HIDDEN])
            da[:HIDDEN] *= dh
            dh -= dn
            s = slope[:HIDDEN]
            np.abs(n, out=s)
            np.subtract(one, s, out=s)
            s *= s
            dn *= s
            np.multiply(dn, own, out=da[HIDDEN:both])
            np.multiply(dn, w[HIDDEN:], out=da[both:])
            np.abs(g, out=slope)
            np.subtract(one, slope, out=slope)
            slope *= slope
            slope *= half
            da[:both] *= slope
            dx[t, :, :both] = da[:both].T
            dx[t, :, both:] = dn.T
            grads.u += da @ h.T
            dh += back @ da
            if starts[t]:
                dh[:, fresh[t]] = 0
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        symbols, first = np.unique(flat[order], return_index=True)
        grads.inputs[:, symbols] += np.add.reduceat(dx.reshape(-1, 3 * HIDDEN).take(order, axis=0), first, axis=0).T


def _inputs(symbols: np.ndarray, owner: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each step and where texts start; before a text stands the end symbol."""
    fresh = np.ones(owner.shape, bool)
    fresh[1:] = owner[1:] != owner[:-1]
    before = np.full(symbols.shape, end, np.int32)
    before[1:] = symbols[:-1]
    before[fresh] = end
    return before, fresh


def score_texts(model: Gru, texts: list[np.ndarray], end: int, lanes: int = 160, window: int = 64) -> np.ndarray:
    """Natural log probability of each symbol sequence."""
    symbols, owner = lanes_of(texts, max(1, min(lanes, len(texts))))
    before, fresh = _inputs(symbols, owner, end)
    total, h = np.zeros(len(texts)), np.zeros((symbols.shape[1], HIDDEN), np.float32)
    for t in range(0, len(symbols), window):
        part = slice(t, t + window)
        live = (owner[part] >= 0).any(0)
        if not live.all():  # lanes that are over drop out
            keep = np.flatnonzero(live)
            symbols, owner, before, fresh, h = symbols[:, keep], owner[:, keep], before[:, keep], fresh[:, keep], h[keep]
        out, h = model.states(before[part], fresh[part], h)
        real = np.flatnonzero(owner[part] >= 0)
        states, targets, of = out.reshape(-1, HIDDEN), symbols[part].ravel(), owner[part].ravel()
        if len(real) < len(of):
            states, targets, of = states[real], targets[real], of[real]
        total += np.bincount(of, model.log_probs(states, targets)[0], len(texts))
    return total


class Adam:
    """Moments of the gradient for one run of training."""

    def __init__(self) -> None:
        self.first, self.second, self.step = np.zeros(Gru.SIZE, np.float32), np.zeros(Gru.SIZE, np.float32), 0

    def move(self, model: Gru, g: np.ndarray, rate: float) -> None:
        norm = float(np.linalg.norm(g))
        if norm > 1:
            g /= norm
        self.step += 1
        self.first += 0.1 * (g - self.first)
        g *= g
        g -= self.second
        self.second += 0.01 * g
        model.flat -= (rate / (1 - 0.9**self.step)) * self.first / (np.sqrt(self.second * (1 / (1 - 0.99**self.step))) + 1e-7)


def train_texts(model: Gru, texts: list[np.ndarray], end: int, rate: float, epochs: int = 1, lanes: int = 64, window: int = 32, longest: int = 4096, adam: Adam | None = None) -> int:
    """Truncated backpropagation with Adam over the sequences, in place; returns the symbols seen.

    The state is carried from window to window; a sequence beyond `longest` symbols is learned in parts of that length, each from a zero state.
    """
    if not texts:
        return 0
    adam, seen = adam or Adam(), 0
    parts = [t[k : k + longest] for t in texts for k in range(0, len(t), longest)]
    symbols, owner = lanes_of(parts, max(1, min(lanes, len(parts))))
    before, fresh = _inputs(symbols, owner, end)
    for _ in range(epochs):
        h = np.zeros((symbols.shape[1], HIDDEN), np.float32)
        for t in range(0, len(symbols), window):
            part = slice(t, t + window)
            kept, grads = [], Gru(np.zeros(Gru.SIZE, np.float32))
            out, h = model.states(before[part], fresh[part], h, kept)
            real = np.flatnonzero(owner[part] >= 0)
            n, states, targets = len(real), out.reshape(-1, HIDDEN), symbols[part].ravel()
            if n == len(targets):
                _, dout = model.log_probs(states, targets, grads, 1 / n)
            else:
                dout = np.zeros((HIDDEN, len(targets)), np.float32).T
                _, dout[real] = model.log_probs(states[real], targets[real], grads, 1 / n)
            model.backward(before[part], fresh[part], kept, dout.reshape(out.shape), grads)
            adam.move(model, grads.flat, rate)
            seen += n
    return seen


def buckets_of(words: pa.Array) -> np.ndarray:
    """The bucket of each word: its last two characters, by CRC-32."""
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    numbers = np.array([zlib.crc32(e.encode("utf-8")) % BUCKETS for e in ends.dictionary.to_pylist()], dtype=np.int32)
    return numbers[ends.indices.to_numpy()]


@dataclass
class Vocabulary:
    """What every task needs of the counts: the head's words, their counts and symbols, and the buckets' totals. Bounded by `head`."""

    words: pa.Array
    counts: np.ndarray
    symbol_of: np.ndarray  # of each head word: its own symbol or its bucket's
    extra: np.ndarray  # log10 of a head word's share of its bucket, 0 where it is a symbol itself
    symbol: dict[str, int]
    bucket_symbol: np.ndarray
    bucket_log: np.ndarray  # log10 of the buckets' totals
    frequency: np.ndarray
    end: int
    train_tokens: int
    train_types: int
    train_docs: int

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each word its place in the head (-1: none) and its symbol; of the words outside the head their buckets and themselves."""
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        outside = place < 0
        rare = words.filter(pa.array(outside))
        symbols = self.symbol_of[place] if len(self.symbol_of) else np.zeros(len(place), np.int32)
        bucket = buckets_of(rare)
        symbols[outside] = self.bucket_symbol[bucket]
        return place, symbols, bucket, rare

    def sequences(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The symbols of texts end to end, each text's followed by the end symbol."""
        ends = np.cumsum(sizes + 1)
        flat = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int32)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        flat[inner] = symbols
        return flat


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) of all training documents, written once; counts are summed in each task before the shuffle."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 0, 16_000_000):
            found = pc.value_counts(words_of(batch.column(0), SPACED_BYTES)[0])
            for k in range(0, len(found), 100_000):
                part = found[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([part.field("values"), part.field("counts")], names=["word", "c"])

    parts = docs.select(text_col).mapInArrow(tally, "word string, c long")
    return stored(parts.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


LONGEST_HEAD_WORD = 100


def rung() -> Column:
    """Steps of a factor of 2^(1/8) in counts: which words make the head hangs on these alone."""
    return F.floor(F.log2(F.col("c")) * 8).cast("int")


def in_head(least: int) -> Column:
    return (rung() >= least) & (F.length("word") <= LONGEST_HEAD_WORD)


def head_rung(counts: DataFrame, head: int) -> int:
    """The least step of counts from which up there are at most `head` words."""
    held, least = 0, 1 << 30
    for r in sorted(counts.groupBy(rung().alias("rung")).count().collect(), key=lambda r: -r["rung"]):
        held += r["count"]
        if held > head:
            break
        least = r["rung"]
    return least


def vocabulary(counts: DataFrame, n_docs: int, head: int) -> Vocabulary:
    n_symbols = SYMBOLS - BUCKETS - 1
    found = counts.filter(in_head(head_rung(counts, head))).toArrow().sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
    words = pa.array([], pa.string()) if not len(found) else found["word"].chunk(0).cast(pa.string())
    count = found["c"].to_numpy().astype(np.int64)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    by_bucket = counts.groupBy(F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS)).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    mass, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in by_bucket:
        mass[r["b"]], types[r["b"]] = r["c"], r["v"]
    bucket, top = buckets_of(words), words[:n_symbols].to_pylist()
    np.subtract.at(mass, bucket[: len(top)], count[: len(top)])
    np.subtract.at(types, bucket[: len(top)], 1)
    ranked = sorted(
        [(int(c), 0, w) for w, c in zip(top, count[: len(top)], strict=True)] + [(int(mass[b]), 1, b) for b in range(BUCKETS)] + [(n_docs, 2, 0)], key=lambda x: (-x[0], x[1], str(x[2]))
    )
    symbol, bucket_symbol, end, frequency = {}, np.zeros(BUCKETS, np.int32), 0, np.zeros(SYMBOLS)
    for s, (c, kind, what) in enumerate(ranked):
        frequency[s] = c
        if kind == 0:
            symbol[what] = s
        elif kind == 1:
            bucket_symbol[what] = s
        else:
            end = s
    bucket_log = np.log10(mass + types + 1)
    symbol_of, extra = bucket_symbol[bucket], np.log10(count + 1.0) - bucket_log[bucket]
    symbol_of[: len(top)], extra[: len(top)] = [symbol[w] for w in top], 0
    return Vocabulary(words, count, symbol_of, extra, symbol, bucket_symbol, bucket_log, frequency, end, total["n"] + n_docs, total["v"] + (n_docs > 0), n_docs)


ENCODED = "row long, doc string, place long, n_tokens long, known long, base double, extra double, rare array<string>, symbols binary"


def encoded(docs: DataFrame, text_col: str, vocab: Vocabulary, id_col: str) -> DataFrame:
    """One row per input row, written once: what the counts of the head say of its words, its words outside the head, and its symbols (two bytes each).

    `extra` is the log10 share of the words in their buckets, as far as the head goes; `place` draws the seed.
    """
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shipped.value
        logs = np.log10(vocab.counts + 1.0)
        floor, end = np.log10(vocab.train_tokens + vocab.train_types + 1), np.log10(vocab.train_docs + 1)
        for batch in grouped(batches, 0, 6_000_000):
            words, sizes = words_of(batch.column(0), SPACED_BYTES)
            place, symbols, bucket, rare = vocab.look_up(words)
            n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            inside = place >= 0
            at, of, beyond = place[inside], owner[inside], owner[~inside]
            base = np.bincount(of, logs[at], n) + end - (sizes + 1) * floor
            extra = np.bincount(of, vocab.extra[at], n) - np.bincount(beyond, vocab.bucket_log[bucket], n)
            known = np.bincount(of, minlength=n) + (vocab.train_docs > 0)
            ends = np.r_[0, np.cumsum(np.bincount(beyond, minlength=n))].astype(np.int32)
            flat = vocab.sequences(symbols, sizes).astype("<u2")
            cuts = np.r_[0, 2 * np.cumsum(sizes + 1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in (1, 2, 3)),
                    pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(extra, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(ends), rare),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(flat)]),
                ],
                names=["row", "doc", "place", "n_tokens", "known", "base", "extra", "rare", "symbols"],
            )

    place = F.pmod(F.xxhash64(F.lit("seed"), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    rows = docs.select(F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc"), place.alias("place"))
    return stored(rows.mapInArrow(run, ENCODED), "lm-symbols")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), "<u2").astype(np.int32) for b in column]


def fit_encoded(rows: DataFrame, vocab: Vocabulary, seed_tokens: int = 300_000, seed_docs: int = 800, epochs: int = 4, rate: float = 1e-3) -> np.ndarray:
    """Weights from rows of `encoded`: seeded on a bounded sample, refined on all of them and averaged by their symbols.

    Every partition is one run of training from the seed's weights, so weights and scores hang on how the rows are split. With the same split they are the same: partitions
    are merged in the order of their numbers, in two levels down to one row.
    """
    model, spark = Gru.start(vocab.frequency), rows.sparkSession
    share = min(seed_tokens, 20 * seed_tokens // max(1, seed_docs) + 1)  # of one text, so that what comes to the driver is bounded by 80 bytes a seed token
    sample = rows.filter(F.col("place") < int((1 << 30) * min(1.0, seed_docs / max(1, vocab.train_docs)))).select("place", F.substring("symbols", 1, 2 * share).alias("symbols"))
    drawn = sorted((r["place"], bytes(r["symbols"])) for r in sample.limit(2 * seed_docs).collect())
    picked, n = [], 0
    for _, s in drawn:
        picked.append(np.frombuffer(s, "<u2").astype(np.int32))
        n += len(picked[-1])
        if n >= seed_tokens:
            break
    train_texts(model, picked, vocab.end, 5e-3, epochs)
    train_texts(model, picked, vocab.end, 1e-3, 1)
    shipped, end = spark.sparkContext.broadcast(model.flat), vocab.end
    names, schema = ["part", "n", "w"], "part long, n double, w binary"

    def row(part: int, n: float, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.float64()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=names)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, adam, seen = Gru(shipped.value.copy()), Adam(), 0
        for batch in grouped(batches, 0, 2_000_000):
            seen += train_texts(own, _sequences(batch.column(0)), end, rate, lanes=160, adam=adam)
        if seen:
            yield row(TaskContext.get().partitionId(), seen, own.flat)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, first = np.zeros(Gru.SIZE), 0.0, None
        for b in batches:
            for part, seen, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                total += seen * np.frombuffer(w.as_py(), np.float32)
                n += seen
                first = part if first is None else first
        if n:
            yield row(first, n, total / n)

    parts = rows.select("symbols").mapInArrow(refine, schema)
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    merged = parts.repartition(groups, F.floor(F.col("part") / groups)).sortWithinPartitions("part").mapInArrow(average, schema)
    found = merged.repartition(1).sortWithinPartitions("part").mapInArrow(average, schema).first()
    return model.flat if found is None else np.frombuffer(bytes(found["w"]), np.float32)


def fit(train: DataFrame, text_col: str, vocab: Vocabulary, id_col: str, **options) -> np.ndarray:
    """Weights from documents; see `fit_encoded`."""
    return fit_encoded(encoded(train, text_col, vocab, id_col), vocab, **options)


@dataclass
class LanguageModel:
    """A trained model: the counts (word, c) as a table, what tasks need of them, and the weights."""

    counts: DataFrame
    head_rung: int
    vocab: Vocabulary
    weights: np.ndarray


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 300_000, **options) -> LanguageModel:
    """The model of all of `docs`."""
    counts, rung, vocab = counted(docs, text_col, head)
    return LanguageModel(counts, rung, vocab, fit(docs, text_col, vocab, id_col, **options))


def counted(docs: DataFrame, text_col: str, head: int) -> tuple[DataFrame, int, Vocabulary]:
    ship(docs.sparkSession)
    counts = count_words(docs, text_col)
    return counts, head_rung(counts, head), vocabulary(counts, docs.count(), head)


SCORED = "row long, doc string, n_tokens long, known long, base double, score double"


def score_encoded(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of `encoded`: doc (the id as text), n_tokens, n_known, base_score, score."""
    shipped = rows.sparkSession.sparkContext.broadcast(model.weights)
    end = model.vocab.end

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gru(shipped.value)
        for batch in grouped(batches, 6, 2_000_000):
            total = score_texts(own, _sequences(batch.column(6)), end) / np.log(10) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(total, pa.float64())], names=["row", "doc", "n_tokens", "known", "base", "score"])

    # words outside the head: their counts come by a join, summed for each row
    seen = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    tail = model.counts.filter(~in_head(model.head_rung))
    more = seen.join(tail, "word").groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    out, logs = rows.select("row", "doc", "n_tokens", "known", "base", "extra", "symbols").mapInArrow(scored, SCORED).join(more, "row", "left"), F.coalesce("logs", F.lit(0.0))
    return out.select("doc", "n_tokens", (F.col("known") + F.coalesce("n", F.lit(0))).alias("n_known"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def score_rows(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score_encoded` of documents."""
    return score_encoded(encoded(docs, text_col, model.vocab, id_col), model)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, head: int = 300_000) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns from all rows of the other folds."""
    counts, rung, vocab = counted(docs.filter(fold(F.col(id_col), modulus) != held_out), text_col, head)
    rows = encoded(docs, text_col, vocab, id_col)
    model = LanguageModel(counts, rung, vocab, fit_encoded(rows.filter(fold(F.col("doc"), modulus) != held_out), vocab))
    ident = F.col("doc").cast(docs.schema[id_col].dataType)
    return score_encoded(rows, model).select(
        ident.alias(id_col), (fold(F.col("doc"), modulus) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(int(vocab.train_tokens)).cast("long").alias("train_tokens"), "base_score", "score"
    )
