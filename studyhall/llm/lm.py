"""LM scoring by masked pseudo-likelihood with a bidirectional window network (numpy).

Every word is predicted from the words on both sides of it. The model factors a word's probability
into its class given the window, its bucket given the class and the word given its bucket:

    log p(word | window) = log p(class | classes of the 2 words before and the 2 after) + log p(bucket | class) + log p(word | bucket)

* Every distinct word (a 64-bit hash) is counted over all documents; partial counts of each task are
  summed by a grouped aggregate. Words fall into 2**bits buckets by their hash. Classes follow from the buckets' counts: the
  most frequent ones have one of their own, the rest is cut into bands of equal mass. ``p(bucket | class)`` is the smoothed
  share. ``p(word | bucket)`` is the word's exact share of its bucket: 1 where it is alone.
* The network (one-hot window, tanh layer, softmax over classes) is trained by mini-batch Adagrad over
  all documents: each task passes over its documents, predicting each of their words once, from
  the common start of the round, and the tasks' parameters are averaged by words seen.
* Scoring masks every word of every document in turn and sums the conditional log-probabilities.

The bucket counts, the parameters and the shares of up to HELD_WORDS of the most frequent words in shared buckets are the only broadcast
data, of bounded size. The table of all words stays distributed: the rarer words in shared buckets are joined to it by their hash.

Defined results: null text is empty; a text without words has 0 words and log-probability 0 (mean
null); repeated rows count each time; an empty corpus gives uniform probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.llm.common import written
from studyhall.llm.hashing import U64, batches, word_hashes

# Words in shared buckets whose shares are broadcast, the most frequent ones; and entries a task counts before it hands them on.
HELD_WORDS = 1 << 17
TASK_WORDS = 1 << 20


@dataclass(frozen=True)
class Params:
    bits: int = 17
    classes: int = 64
    own: int = 32          # most frequent words with a class of their own
    reach: int = 2         # words on either side
    hidden: int = 24
    rounds: int = 2
    masked: float = 1.0    # share of the words predicted in training: every one
    rate: float = 0.15
    batch: int = 4096


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode() if t else b"" for t in frame["text"]]


def _words(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_hashes(texts)
    return (h >> U64(64 - p.bits)).astype(np.int32), at


def count_words(docs: DataFrame, p: Params = Params()) -> np.ndarray:
    """Occurrences of each bucket over all documents."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << p.bits, dtype=np.int64)
        for f in frames:
            for run_ in batches(_texts(f)):
                total += np.bincount(_words(run_, p)[0], minlength=1 << p.bits)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = rows.toPandas()  # at most 2**bits rows
    out = np.zeros(1 << p.bits, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def word_table(docs: DataFrame) -> DataFrame:
    """(word, n): every distinct word, as its hash, and its occurrences over all documents."""
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return words, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(words)).astype(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for f in frames:
            for run_ in batches(_texts(f)):
                words, n = np.unique(word_hashes(run_)[0], return_counts=True)
                parts.append((words, n))
                held += len(words)
                if held > TASK_WORDS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                if held > TASK_WORDS // 2 and len(parts) == 1:
                    yield pd.DataFrame({"word": parts[0][0].view(np.int64), "n": parts[0][1]})
                    parts, held = [], 0
        if parts:
            words, n = merged(parts)
            yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_counts(words: DataFrame, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, distinct words) of each bucket, from ``word_table``."""
    rows = words.groupBy(F.shiftrightunsigned("word", 64 - p.bits).alias("bucket")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toPandas()  # at most 2**bits rows
    out = np.zeros((2, 1 << p.bits), dtype=np.int64)
    out[:, rows["bucket"].to_numpy(dtype=np.int64)] = rows[["n", "k"]].to_numpy(dtype=np.int64).T
    return out[0], out[1]


@dataclass
class Shares:
    """log p(word | bucket) of the words in shared buckets: the most frequent ones as sorted arrays, the rest as a table
    (word, log_share), None if there are no others."""
    shared: np.ndarray
    words: np.ndarray
    log_share: np.ndarray
    rest: DataFrame | None

    @classmethod
    def from_words(cls, words: DataFrame, distinct: np.ndarray, p: Params) -> "Shares":
        at = F.shiftrightunsigned("word", 64 - p.bits)
        buckets = words.groupBy(at.alias("bucket")).agg(F.sum("n").alias("in_bucket"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        rows = words.withColumn("bucket", at).join(buckets, "bucket").select(
            "word", "n", (F.log("n") - F.log("in_bucket")).alias("log_share"))
        # how many words have each count tells from which count on they are held
        sizes = rows.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toPandas()
        fits = sizes["k"].cumsum() <= HELD_WORDS
        least = int(sizes["n"][fits].min()) if fits.any() else np.iinfo(np.int64).max
        held = rows.filter(F.col("n") >= least).select("word", "log_share").toPandas()
        keys = held["word"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        return cls(distinct > 1, keys[order], held["log_share"].to_numpy(dtype=np.float64)[order],
                   None if fits.all() else rows.filter(F.col("n") < least).select("word", "log_share"))


@dataclass
class Vocabulary:
    """Class of each bucket and log p(bucket | class)."""
    of: np.ndarray
    log_share: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, p: Params) -> "Vocabulary":
        order = np.lexsort((np.arange(len(counts)), -counts))
        of = np.empty(len(counts), dtype=np.int16)
        of[order[:p.own]] = np.arange(p.own)
        rest = order[p.own:]
        mass = np.cumsum(counts[rest] + 1.0)
        bands = p.classes - p.own
        of[rest] = p.own + np.minimum(bands - 1, (mass * bands / mass[-1]).astype(int))
        smooth = counts + 0.5
        share = smooth / np.bincount(of, weights=smooth, minlength=p.classes)[of]
        return cls(of, np.log(share).astype(np.float32))


def windows(classes: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """(words, 2 * reach) class ids around each word; ``p.classes`` stands for outside the text."""
    first, last = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
    here = np.arange(len(classes))
    padded = np.append(classes, p.classes).astype(np.int16)
    out = np.empty((len(classes), 2 * p.reach), dtype=np.int16)
    for k, d in enumerate([*range(-p.reach, 0), *range(1, p.reach + 1)]):
        j = here + d
        out[:, k] = padded[np.where((j >= first) & (j < last), j, len(classes))]
    return out


class Network:
    """Class scores of a masked word from the classes of its window."""

    def __init__(self, p: Params, flat: np.ndarray | None = None):
        self.p = p
        self.shapes = [(2 * p.reach * (p.classes + 1), p.hidden), (p.hidden,), (p.hidden, p.classes), (p.classes,)]
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.concatenate([(rng.standard_normal(s) * (0.3 if len(s) > 1 else 0.0)).ravel() for s in self.shapes])
        cuts = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        self.w = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(np.asarray(flat), cuts), self.shapes)]
        self.seen = [np.full(s, 1e-3, dtype=np.float32) for s in self.shapes]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    def _rows(self, window: np.ndarray) -> np.ndarray:
        return window.astype(np.int32) + np.arange(window.shape[1], dtype=np.int32) * (self.p.classes + 1)

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, log p(class))."""
        a, b, c, d = self.w
        rows = self._rows(window)
        h = a[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            h += a[rows[:, k]]
        h = np.tanh(h + b)
        z = h @ c
        z += d
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return h, z

    def step(self, window: np.ndarray, target: np.ndarray) -> None:
        h, z = self.forward(window)
        g = np.exp(z)
        g[np.arange(len(target)), target] -= 1.0
        g /= len(target)
        back = (g @ self.w[2].T) * (1.0 - h * h)
        grad_a = np.zeros_like(self.w[0])
        width = self.p.classes + 1
        for k in range(window.shape[1]):
            hot = np.zeros((len(window), width), dtype=np.float32)
            hot[np.arange(len(window)), window[:, k]] = 1.0
            grad_a[k * width:(k + 1) * width] = hot.T @ back
        for w, s, grad in zip(self.w, self.seen, [grad_a, back.sum(axis=0), h.T @ g, g.sum(axis=0)]):
            s += grad * grad
            w -= self.p.rate * grad / np.sqrt(s)


def train(docs: DataFrame, vocabulary: Vocabulary, p: Params = Params()) -> np.ndarray:
    """Parameters after ``rounds`` of training in all tasks and averaging. A round takes the documents
    whose id hash falls to it, so that each document is trained on once."""
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)
    flat = Network(p).flat()
    turn = F.pmod(F.xxhash64("id"), F.lit(p.rounds))
    for r in range(p.rounds):
        start = sc.broadcast(flat)

        def run(frames: Iterator[pd.DataFrame], start=start, r=r) -> Iterator[pd.DataFrame]:
            net, seen = Network(p, start.value), 0
            rng = np.random.default_rng(100 + r)
            left: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for f in frames:
                for run_ in batches(_texts(f)):
                    ids, at = _words(run_, p)
                    classes = words.value.of[ids]
                    hidden = np.flatnonzero(rng.random(len(ids)) < p.masked)
                    left.append((windows(classes, at, p)[hidden], classes[hidden]))
                    held += len(hidden)
                    if held >= p.batch:
                        x, y = np.concatenate([a for a, _ in left]), np.concatenate([b for _, b in left])
                        full = len(x) - len(x) % p.batch
                        for i in range(0, full, p.batch):
                            net.step(x[i:i + p.batch], y[i:i + p.batch])
                        seen += full
                        left, held = [(x[full:], y[full:])], len(x) - full
            if held:
                x, y = np.concatenate([a for a, _ in left]), np.concatenate([b for _, b in left])
                net.step(x, y)
                seen += len(x)
            if seen:
                out = net.flat().astype(np.float64)
                yield pd.DataFrame({"at": np.arange(len(out) + 1), "w": np.append(out * seen, float(seen))})

        sums = (docs.filter(turn == r).select("text").mapInPandas(run, "at long, w double")
                .groupBy("at").agg(F.sum("w").alias("w")).toPandas())
        start.unpersist()
        if len(sums):
            w = np.zeros(len(flat) + 1)
            w[sums["at"].to_numpy(dtype=np.int64)] = sums["w"].to_numpy()
            flat = w[:-1] / w[-1]
    return flat


def score(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, p: Params = Params(), shares: Shares | None = None) -> DataFrame:
    """(id, n_words, log_prob, mean_log_prob) of every row of (id, text). Without ``shares`` words of one bucket count as one."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (vocabulary, flat, (shares.shared, shares.words, shares.log_share) if shares else None))
    joined = shares is not None and shares.rest is not None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, weights, held = sent.value
        net = Network(p, weights)
        for f in frames:
            n, total, rest = [], [], []
            for run_ in batches(_texts(f)):
                hashes, at = word_hashes(run_)
                ids = (hashes >> U64(64 - p.bits)).astype(np.int32)
                classes = words.of[ids]
                window = windows(classes, at, p)
                each = words.log_share[ids].astype(np.float64)
                for i in range(0, len(ids), p.batch):
                    _, z = net.forward(window[i:i + p.batch])
                    each[i:i + p.batch] += z[np.arange(len(z)), classes[i:i + p.batch]]
                if held:
                    shared, keys, log_share = held
                    among = np.flatnonzero(shared[ids])
                    found = np.searchsorted(keys, hashes[among])
                    found[found == len(keys)] = 0
                    known = keys[found] == hashes[among] if len(keys) else np.zeros(len(among), dtype=bool)
                    each[among[known]] += log_share[found[known]]
                    if joined:
                        other = among[~known]
                        cuts = np.searchsorted(other, at)
                        left = hashes[other].view(np.int64)
                        rest += [left[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                sums = np.concatenate([[0.0], np.cumsum(each)])
                n.append(np.diff(at))
                total.append(sums[at[1:]] - sums[at[:-1]])
            n = np.concatenate([np.empty(0, dtype=np.int64), *n]).astype(np.int64)
            total = np.concatenate([np.empty(0), *total])
            yield pd.DataFrame({"id": f["id"], "n_words": n, "log_prob": total} | ({"rest": rest} if joined else {}))

    schema = "id long, n_words long, log_prob double"
    out = docs.select("id", "text").mapInPandas(run, schema + (", rest array<long>" if joined else ""))
    if joined:
        # the rows get a number of their own that stays: ids may repeat
        out = written(out.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
        more = (out.select("row", F.explode("rest").alias("word")).join(shares.rest, "word")
                .groupBy("row").agg(F.sum("log_share").alias("more")))
        out = out.join(more, "row", "left").select(
            "id", "n_words", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    return out.withColumn("mean_log_prob", F.col("log_prob") / F.nullif(F.col("n_words"), F.lit(0)))


def pseudo_likelihood(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fit on all rows of (id, text) and score all of them."""
    words = written(word_table(docs), "lm-words")
    counts, distinct = bucket_counts(words, p)
    vocabulary = Vocabulary.from_counts(counts, p)
    return score(docs, vocabulary, train(docs, vocabulary, p), p, Shares.from_words(words, distinct, p))
