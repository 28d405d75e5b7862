"""Quality classifier as a sparse rule ensemble.

Boosted shallow trees are grown over text statistics of labelled documents; every path from a root to a node is a conjunctive
rule. A logistic model over the rules is fitted with an L1 penalty, so that few keep a weight, and the rules that do are compiled
into Spark column expressions: scoring is a projection, without Python.

The fit takes at most `most_rows` labelled rows, those of the smallest XXH64 of the id, ties by id and label; the bound is a parameter. Statistics and
scores use whole texts of all documents, however long. Null counts as the empty text, which is one empty word on one empty line and has a score like any other.
Rows with a null label or id are not learned from; of repeated documents with a label each is learned from; with no labels, or labels of one class, every score is that class's
share (0.5 without any), as for an empty table of documents. Repeated rows, and rows with a null id, are each scored. Other columns of the input are kept, whatever their names, but
for one called like the score's column, which the score replaces. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.text_rules import fold

_P = "__qr_"
#: Characters that a share is taken of, as patterns (fixed values).
SHARES = {"upper": r"\p{Lu}", "bang": "[!?]", "symbol": r"[#$%&*+/<=>@\\^_`{}~]", "pipe": r"[|]", "digit": "[0-9]", "stop": "[.,;:]"}
STATISTICS = ["chars", "words", "word_chars", "distinct", "lines", "line_words", "distinct_lines", *SHARES]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` and its statistics, one prefixed double column each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = docs.withColumn(f"{_P}t", text)
    t = F.col(f"{_P}t")
    at = at.withColumns({f"{_P}w": F.split(F.trim(F.regexp_replace(t, r"[\x09-\x0D]", " ")), " +"), f"{_P}l": F.split(t, "\n")})
    w, lines = F.col(f"{_P}w"), F.col(f"{_P}l")
    n_chars, n_words, n_lines = F.length(t).cast("double"), F.size(w).cast("double"), F.size(lines).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    stats = {
        "chars": F.log1p(n_chars),
        "words": F.log1p(n_words),
        "word_chars": share(n_chars, n_words),
        "distinct": share(F.size(F.array_distinct(w)).cast("double"), n_words),
        "lines": F.log1p(n_lines),
        "line_words": share(n_words, n_lines),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), n_lines),
    } | {k: share(F.regexp_count(t, F.lit(p)).cast("double"), n_words) for k, p in SHARES.items()}
    return at.withColumns({f"{_P}{k}": v for k, v in stats.items()}).drop(f"{_P}t", f"{_P}w", f"{_P}l")


@dataclass
class Rules:
    """A logistic model over conjunctions: each rule is a list of (statistic, lower bound, upper bound), lo <= x < hi."""

    intercept: float
    rules: list[tuple[float, list[tuple[str, float, float]]]]

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for weight, parts in self.rules:
            held = F.lit(True)
            for name, lo, hi in parts:
                c = F.col(f"{_P}{name}")
                if np.isfinite(lo):
                    held = held & (c >= float(lo))
                if np.isfinite(hi):
                    held = held & (c < float(hi))
            total = total + F.when(held, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, n_bins: int, least: int) -> tuple[list[dict], np.ndarray]:
    """A tree of Newton gains on binned columns: its nodes' bin ranges, and the fitted step of each row."""
    step, paths = np.zeros(len(gradient)), []
    open_nodes = [(np.arange(len(gradient)), {}, 0)]
    while open_nodes:
        rows, ranges, level = open_nodes.pop()
        g, h = gradient[rows], hessian[rows]
        G, H = g.sum(), h.sum()
        if ranges:
            paths.append(ranges)
        best = (1e-3, None, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                gs, hs = np.bincount(b, g, n_bins).cumsum()[:-1], np.bincount(b, h, n_bins).cumsum()[:-1]
                ns = np.bincount(b, minlength=n_bins).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            step[rows] = -G / (H + 1)
            continue
        _, f, k = best
        lo, hi = ranges.get(f, (0, n_bins))
        left = bins[rows, f] <= k
        open_nodes += [(rows[left], ranges | {f: (lo, k + 1)}, level + 1), (rows[~left], ranges | {f: (k + 1, hi)}, level + 1)]
    return paths, step


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the L1-penalised logistic loss; the intercept goes free."""
    n, m = x.shape
    w, v, b, t = np.zeros(m, np.float32), np.zeros(m, np.float32), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 1.0
    u = np.ones(m, np.float32) / np.sqrt(m)
    for _ in range(15):  # the largest eigenvalue bounds the step
        u = x.T @ (x @ u)
        u /= np.linalg.norm(u) + 1e-9
    rate = 4.0 / (float(np.linalg.norm(x @ u)) ** 2 / n + 1)
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-(x @ v + b))) - y).astype(np.float32)
        z = v - rate * (x.T @ r) / n
        new = np.sign(z) * np.maximum(np.abs(z) - rate * penalty, 0)
        b -= 0.5 * rate * float(r.mean())
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + np.float32((last - 1) / t) * (new - w)
        w = new
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, n_bins: int = 48, rate: float = 0.3, penalty: float = 2e-3, rounds: int = 300, seed: int = 7) -> Rules:
    """Rules from boosted trees over the columns STATISTICS of x; y holds 0 and 1."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Rules(float(np.log((p + 1e-3) / (1 - p + 1e-3))), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    rng, margin, paths = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        some = rng.random(len(y)) < 0.6
        found, _ = _grow(bins[some], (p - y)[some], (p * (1 - p))[some], depth, n_bins, max(5, len(y) // 200))
        full = np.zeros(len(y))
        leaves = [r for r in found if not any(r != q and all(k in q for k in r) and all(r[k][0] <= q[k][0] and q[k][1] <= r[k][1] for k in r) for q in found)]
        for r in leaves:
            rows = np.logical_and.reduce([(bins[:, f] >= a) & (bins[:, f] < b) for f, (a, b) in r.items()])
            full[rows] = -(p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + 1)
        margin = margin + rate * full
        for r in found:
            paths[tuple(sorted(r.items()))] = r
    rules = list(paths.values())
    z = np.stack([np.logical_and.reduce([(bins[:, f] >= a) & (bins[:, f] < b) for f, (a, b) in r.items()]) for r in rules], axis=1).astype(np.float32)
    weight, intercept = _lasso(z, y.astype(np.float32), penalty, rounds)
    bound = lambda f, k: -np.inf if k == 0 else np.inf if k > len(edges[f]) else float(edges[f][k - 1])
    kept = [(float(w), [(STATISTICS[f], bound(f, a), bound(f, b)) for f, (a, b) in r.items()]) for w, r in zip(weight, rules, strict=True) if abs(w) > 1e-4]
    return Rules(float(intercept), kept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held_out: int = 1, most_rows: int = 20_000) -> Rules:
    """Fit on labelled rows outside the held-out fold, those of the least hashes, at most `most_rows`. Equal labels of an id count once, and an id has one text."""
    named = (
        labels.select(F.col(id_col).alias(f"{_P}id"), F.col(label_col).cast("double").alias(f"{_P}y"))
        .filter(F.col(f"{_P}y").isNotNull() & F.col(f"{_P}id").isNotNull() & (fold(F.col(f"{_P}id"), modulus) != held_out))
        .groupBy(f"{_P}id", f"{_P}y")
        .agg(F.count(F.lit(1)).alias(f"{_P}n"))
        .drop(f"{_P}n")
    )
    # the least hashes, of those below a bound that some 1.2 times as many are expected to pass, so that no task sorts the labels
    among = named.count()
    bound = min(1.0, (1.2 * most_rows + 1000) / max(among, 1))
    order = F.pmod(F.xxhash64(f"{_P}id"), F.lit(1 << 30))
    chosen = named.filter(order <= int(bound * (1 << 30))).orderBy(order, f"{_P}id", f"{_P}y").limit(most_rows)
    texts = docs.select(F.col(id_col).alias(f"{_P}id"), F.col(text_col).alias(f"{_P}text")).join(F.broadcast(chosen), f"{_P}id")
    each = with_statistics(texts, f"{_P}text")
    # of the texts of an id that repeats the one of least statistics, so that the bound on labels bounds what is collected
    rows = each.groupBy(f"{_P}id", f"{_P}y").agg(F.min(F.struct(*[f"{_P}{s}" for s in STATISTICS])).alias(f"{_P}s")).select(f"{_P}y", f"{_P}s.*")
    table = np.array([tuple(r) for r in rows.collect()], dtype=np.float64).reshape(-1, len(STATISTICS) + 1)
    table = table[np.lexsort(table.T)]
    return fit(table[:, 1:], table[:, 0])


def score(docs: DataFrame, rules: Rules, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` and the model's probability that a text is of quality.

    The score passes through a one-element explode, beyond which the optimizer pushes no filter: else a filter on the score
    would copy each statistic into every rule that names it.
    """
    scored = with_statistics(docs, text_col).withColumn(f"{_P}score", F.explode(F.array(rules.score())))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col], F.col(f"{_P}score").alias(score_col))


def keep_quality(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows with a score of 0.5 or more, with the columns of `docs`."""
    scored = score(docs, rules, text_col, f"{_P}kept").filter(F.col(f"{_P}kept") >= 0.5)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
