"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark column expressions.

Statistics of whole texts are computed batch by batch. Boosted shallow trees are grown on a bounded sample of labelled
rows (``MAX_TRAINING_ROWS``, the rows of least hash; only their statistics reach the driver). Every path from a root
to a node becomes a conjunctive rule. L1-penalised logistic regression weighs the rules, most weights become zero, and
the rest are compiled into one column expression, so scoring is a single pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_of

#: The most labelled rows that a fit takes; above it, those of least XXH64 of their id.
MAX_TRAINING_ROWS = 20_000
#: Scores from here on are predicted 1.
CUT = 0.7

# Common words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with by be this at from or an have not which you but has "
    "le la les de des du et un une en que qui dans pour par sur pas avec est au aux ce il elle ne se "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er "
    "el los las y del se una por con no su para es al lo como más o pero sus le ha".split()
)
SYMBOLS = "#$%&*|!@^~<>{}[]\\=+_"

STATISTICS = [
    "chars", "words", "word_chars", "symbols", "bars", "bangs", "digits", "upper", "stops", "stops_any_case", "distinct",
    "lines", "line_repeats", "line_words", "stopped", "commas", "glued", "non_ascii", "longest_word",
]
STATISTICS_TYPE = T.StructType([T.StructField(n, T.DoubleType(), False) for n in STATISTICS])
_UPPER, _DIGIT, _GLUED, _NON_ASCII = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[#$%&*|!]{2,}"), re.compile(r"[^\x00-\x7f]")


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text, all zero for a null or empty one. Shares are of characters, words or lines."""
    t = text or ""
    words = t.split()
    if not words:
        return (float(np.log1p(len(t))), *[0.0] * (len(STATISTICS) - 1))
    n, w = len(t), len(words)
    lines = [x for x in t.split("\n") if x.strip()]
    stops = sum(map(STOP_WORDS.__contains__, words))
    upper = sum(map(len, _UPPER.findall(t)))
    return (
        float(np.log1p(n)),
        float(np.log1p(w)),
        sum(map(len, words)) / w,
        sum(map(t.count, SYMBOLS)) / n,
        t.count("|") / w,
        t.count("!") / w,
        len(_DIGIT.findall(t)) / n,
        upper / n,
        stops / w,
        (sum(map(STOP_WORDS.__contains__, t.lower().split())) if upper > 0.3 * n else stops) / w,
        len(set(words)) / w,
        len(lines) / w,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(w / len(lines))),
        t.count(". ") / w,
        t.count(",") / w,
        len(_GLUED.findall(t)) / w,
        len(_NON_ASCII.findall(t)) / n,
        float(min(max(map(len, words)), 1000)),
    )


def with_statistics(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """Adds a struct column of statistics. All other columns stay."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(STATISTICS_TYPE)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS, dtype=float)

    return docs.withColumn(name, of.asNondeterministic()(text_of(text_col)))


@dataclass
class Rule:
    """A conjunction: (statistic, threshold, True for 'over', False for 'up to') of each condition, and its weight."""

    conditions: tuple[tuple[int, float, bool], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, ((x[:, j] > c) == over for j, c, over in self.conditions), np.ones(len(x), bool))

    def column(self, stats: str) -> Column:
        tests = [(F.col(stats)[STATISTICS[j]] > F.lit(c)) if over else (F.col(stats)[STATISTICS[j]] <= F.lit(c)) for j, c, over in self.conditions]
        return F.when(reduce(Column.__and__, tests), F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str) -> Column:
        """The score as a column expression over a struct of statistics."""
        z = reduce(Column.__add__, (r.column(stats) for r in self.rules), F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[list, list[tuple[Rule, float]]]:
    """Paths of all nodes but the root of one regression tree on gradients g and weights h; and its leaves with their values."""
    paths, leaves = [], []

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        total, weight = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                b = np.searchsorted(edges, x[rows, j], "left")
                n, sg, sh = (np.bincount(b, v, len(edges) + 1).cumsum()[:-1] for v in (None, g[rows], h[rows]))
                gain = sg**2 / (sh + 1) + (total - sg) ** 2 / (weight - sh + 1) - total**2 / (weight + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (j, float(edges[gain.argmax()])))
        if best[1] is None:
            leaves.append((Rule(path), total / (weight + 1)))
            return
        j, c = best[1]
        over = x[rows, j] > c
        for side in (False, True):
            step = (*path, (j, c, side))
            paths.append(step)
            grow(rows[over == side], step, left - 1)

    grow(np.arange(len(x)), (), depth)
    return paths, leaves


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 32, l1: float = 0.002, rounds: int = 400) -> RuleEnsemble:
    """Rules from boosted trees, weighed by lasso logistic regression (accelerated proximal gradient steps).

    Without both labels present, the ensemble has no rules and scores the share of label 1 (0.5 without rows).
    """
    n = len(y)
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return RuleEnsemble(base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    z, found = np.full(n, base), {}
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        part = np.random.default_rng(k).random(n) < 0.7
        paths, leaves = _tree(x[part], (y - p)[part], (p * (1 - p))[part], cuts, depth, max(5, n // 200))
        found.update(dict.fromkeys(tuple(sorted(c)) for c in paths))
        z += 0.3 * sum(value * leaf.holds(x) for leaf, value in leaves)  # all rows walk the tree, drawn or not
    rules = [Rule(c) for c in found]
    cols, seen = [], {}
    for r in rules:
        v = r.holds(x)
        if 0 < v.sum() < n and seen.setdefault(v.tobytes(), r) is r:
            cols.append((r, v.astype(np.float64)))
    if not cols:
        return RuleEnsemble(base)
    m = np.column_stack([v for _, v in cols])
    mean, sd = m.mean(0), np.maximum(m.std(0), 1e-9)
    q = (m - mean) / sd
    size = 4 * n / max(np.linalg.eigvalsh(q.T @ q).max(), 1e-9)
    w, b, u, t = np.zeros(q.shape[1]), base, np.zeros(q.shape[1]), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(b + q @ u))) - y
        nxt = u - size * (q.T @ r) / n
        nxt = np.sign(nxt) * np.maximum(np.abs(nxt) - size * l1, 0)
        b -= 4 * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = nxt + (t - 1) / s * (nxt - w), nxt, s
    weights = w / sd
    kept = [Rule(r.conditions, float(v)) for (r, _), v in zip(cols, weights) if abs(v) > 1e-6]
    return RuleEnsemble(float(b - (weights * mean).sum()), kept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          usable: Column | None = None, most: int = MAX_TRAINING_ROWS) -> RuleEnsemble:
    """Fits an ensemble. ``usable`` says which ids may be learned from (all if None).

    Rows without an id or label are left out; an id with several labels counts once, with the larger.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    ids = ids.where(usable) if usable is not None else ids
    ids = ids.groupBy(id_col).agg(F.max(label_col).cast("double").alias("__label"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(most)  # at most ``most`` pairs of two numbers
    texts = docs.select(id_col, F.col(f"`{text_col}`").alias("__text"))
    rows = with_statistics(texts.join(F.broadcast(ids), id_col), "__stats", "__text")
    # One row an id reaches the driver: the least of those that repeat it.
    got = rows.groupBy(id_col).agg(F.min(F.struct("__label", "__stats")).alias("__r")).select(id_col, "__r.__label", "__r.__stats.*").toPandas().sort_values(id_col)
    return fit_rules(got[STATISTICS].to_numpy(float), got["__label"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted", cut: float = CUT) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``cut`` on) to every row. Null and empty texts are scored too."""
    out = with_statistics(docs, "__landsight_stats", text_col).withColumn(score_col, model.column("__landsight_stats"))
    return out.withColumn(predicted_col, (F.col(score_col) >= cut).cast("int")).drop("__landsight_stats")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose CRC-32 of the id as text leaves 2 modulo 4: never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
