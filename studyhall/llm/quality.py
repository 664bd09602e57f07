"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

1. ``statistics`` computes some twenty numbers of every whole text (lengths, shares of kinds of characters, repetition of
   words and lines); they are columns of a DataFrame.
2. A bounded, documented sample (``Params.rows`` labelled ids, the ones with the smallest hash) grows small boosted trees; the
   path to each node but the root is a rule, a conjunction of comparisons of statistics with thresholds.
3. A logistic regression with an L1 penalty (accelerated proximal gradient) over the rules' 0/1 values keeps a few of them.
4. ``compiled`` turns the kept rules into one Spark column: the sum of ``weight * (conditions)``, through the logistic
   function. Scoring is a projection inside whole-stage code over the statistics, with no broadcast.

Fitting reads numbers of at most ``Params.rows`` ids, in one task of bounded size; scores cover every row.

Defined results: a null text is empty, and an empty text or one without words has zeros for statistics and a score as any other;
texts of any length are read whole; labels other than 0 and 1, ids with both labels, null ids and ids without text are not
learned from; of several texts of one labelled id the one with the least statistics is; without any label every score
is 0.5, with one kind of label only the base rate is learned; empty tables give empty results; further columns of
the tables are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "n_chars", "n_words", "n_lines", "word_length", "line_words", "upper_share", "digit_share", "blank_share",
    "stop_share", "mark_share", "symbol_share", "other_share", "distinct_words", "top_word", "next_equal", "near_equal",
    "distinct_lines", "short_words", "long_words", "marked_words",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_BLANK = bytes([9, 10, 11, 12, 13, 32])
_STOP = b".,;:?"
_MARK = b"!\"'()-"
_SYMBOL = b"#$%&*|+/<=>@[\\]^_`{}~"
_ALPHA = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


@dataclass(frozen=True)
class Params:
    rows: int = 8000        # bound of the labelled sample that is fitted
    trees: int = 60
    depth: int = 3
    rate: float = 0.2       # shrinkage of each tree
    share: float = 0.6      # share of the sample a tree sees
    leaf: int = 10          # rows of a node at least
    bins: int = 32
    l1: float = 0.002
    steps: int = 400
    seed: int = 11


@dataclass(frozen=True)
class Rule:
    """A conjunction: every (statistic, above, threshold) holds; ``above`` means > threshold, else <=."""
    conditions: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]


def text_statistics(text: bytes) -> list[float]:
    """The values of STATISTICS for one text (UTF-8)."""
    size = max(len(text), 1)

    def share(kind: bytes) -> float:
        return (len(text) - len(text.translate(None, kind))) / size
    words = text.split()
    n = max(len(words), 1)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in re.split(rb"[\n\r\x0b\x0c]+", text) if x]
    m = max(len(lines), 1)
    return [
        float(len(text)), float(len(words)), float(len(lines)), sum(map(len, words)) / n, len(words) / m, share(_UPPER),
        share(_DIGIT), share(_BLANK), share(_STOP), share(_MARK), share(_SYMBOL),
        len(text.translate(None, _ALPHA + _DIGIT + _BLANK + _STOP + _MARK + _SYMBOL)) / size,
        len(count) / n, max(count.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n,
        len(set(lines)) / m, sum(len(w) < 3 for w in words) / n, sum(len(w) > 12 for w in words) / n,
        sum(w[-1:] in _MARK + _SYMBOL for w in words) / n,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(id, STATISTICS ...) of every row of (id, text)."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            rows = [text_statistics(t.as_py() or b"") for t in b.column(1).cast(pa.large_binary())]
            values = np.array(rows, dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in values.T]], names=["id", *STATISTICS])
    return docs.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{k} double" for k in STATISTICS))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def grown_rules(x: np.ndarray, y: np.ndarray, p: Params) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths of small boosted trees as tuples of (column, above, threshold), without repeats."""
    rng = np.random.default_rng(p.seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])  # bin <= i: value <= cut i
    margin = np.zeros(len(y))
    rules: dict[tuple, None] = {}

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = (1e-9, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(len(binned)):
            k = len(cuts[f]) + 1
            if k < 2:
                continue
            sums = [np.cumsum(np.bincount(binned[f, rows], weights=w, minlength=k))[:-1]
                    for w in (g[rows], h[rows], np.ones(len(rows)))]
            left_g, left_h, left_n = sums
            ok = (left_n >= p.leaf) & (len(rows) - left_n >= p.leaf)
            gain = np.where(ok, left_g ** 2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1)
                            - total_g ** 2 / (total_h + 1), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
        return best

    for _ in range(p.trees):
        prob = _sigmoid(margin)
        g, h = y - prob, prob * (1 - prob)
        sample = np.flatnonzero(rng.random(len(y)) < p.share)
        queue = [((), sample, np.arange(len(y)))]
        while queue:
            path, rows, every = queue.pop()
            _, f, i = best_split(rows, g, h) if len(path) < p.depth and len(rows) >= 2 * p.leaf else (0, None, None)
            if f is None:
                margin[every] += p.rate * g[rows].sum() / (h[rows].sum() + 1) if len(rows) else 0.0
                continue
            for above in (False, True):
                branch = (*path, (f, above, float(cuts[f][i])))
                rules.setdefault(tuple(sorted(branch)))
                queue.append((branch, rows[(binned[f, rows] > i) == above], every[(binned[f, every] > i) == above]))
    return list(rules)


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with an L1 penalty on the weights, by accelerated proximal gradient."""
    n, m = z.shape
    rate = 4.0 / (np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        error = _sigmoid(z @ v[:-1] + v[-1]) - y
        new = v - rate * np.append(z.T @ error, error.sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1, 0.0)
        new[-1] = np.clip(new[-1], -6.0, 6.0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return float(w[-1]), w[:-1]


def fit(x: np.ndarray, y: np.ndarray, p: Params = Params()) -> Model:
    """A rule ensemble for statistics ``x`` (rows of STATISTICS) and labels ``y`` (0/1)."""
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    rules = grown_rules(x, y.astype(float), p)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    intercept, weights = lasso(z, y.astype(float), p.l1, p.steps)
    kept = [Rule(tuple((STATISTICS[f], above, cut) for f, above, cut in r), float(w))
            for r, w in zip(rules, weights) if w != 0.0]
    return Model(intercept, tuple(kept))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model from ``docs`` (id, text) and ``labels`` (id, label 0/1), both whole tables."""
    known = labels.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(
        F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(p.rows)  # ids only; at most p.rows rows
    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    least = statistics(rows).groupBy("id").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    sample = least.join(chosen, "id").select("id", "label", "s.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        known = pd.concat(held, ignore_index=True).sort_values("id")
        model = fit(known[list(STATISTICS)].to_numpy(dtype=float), known["label"].to_numpy(dtype=np.int64), p)
        rows = [(-1, None, None, None, model.intercept)]
        rows += [(i, k, a, c, r.weight) for i, r in enumerate(model.rules) for k, a, c in r.conditions]
        yield pd.DataFrame(rows, columns=["rule", "statistic", "above", "threshold", "weight"])

    learned = sample.repartition(1).mapInPandas(
        run, "rule int, statistic string, above boolean, threshold double, weight double").collect()
    intercept = next((r["weight"] for r in learned if r["rule"] < 0), 0.0)
    by_rule: dict[int, list] = {}
    for r in learned:
        if r["rule"] >= 0:
            by_rule.setdefault(r["rule"], []).append(r)
    return Model(intercept, tuple(Rule(tuple((c["statistic"], c["above"], c["threshold"]) for c in rs), rs[0]["weight"])
                                  for _, rs in sorted(by_rule.items())))


def compiled(model: Model) -> Column:
    """The model as one Spark column over the statistics' columns."""
    total = F.lit(model.intercept)
    for rule in model.rules:
        met = F.lit(True)
        for name, above, cut in rule.conditions:
            met = met & ((F.col(name) > F.lit(cut)) if above else (F.col(name) <= F.lit(cut)))
        total = total + F.when(met, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of (id, text)."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return statistics(docs).select("id", compiled(model).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4 are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, label) of the ``quality`` labels that may be learned from."""
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).filter(
        ~held_out(F.col("id")))
