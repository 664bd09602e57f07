"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word pairs and pairs with one word left out, hashed to
2**bits coordinates (words are lower-cased in A-Z and stripped of ASCII punctuation at both ends;
the first 4 and 5 bytes of a word are features too, for inflected and compounded abuse). Every coordinate has its own learning rate; the
L1 term keeps most weights at exactly zero, so the model is a short list of (coordinate, weight),
never more than 2**bits of them: the proven bound of what is broadcast.

Training reads at most ``Params.rows`` labelled rows, the ones with the smallest hash of their id: a
bounded sample, the documented limit of this operator. One task runs FTRL over it for a few
epochs; features are kept as 32-bit coordinates, so its memory is bounded by the sample. The
rarer label weighs up to the square root of balance. Scores cover every row of the table.

Defined results: empty text or one without words scores the bias alone; null text is empty;
repeated rows count each time; labels other than 0 and 1 and texts without label are not learned
from; without any labelled row every score is 0.5 and ``predicted`` follows from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.llm.common import worker_state
from studyhall.llm.hashing import U64, batches, combine, mix, word_hashes

_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PUNCT_TO_SPACE = bytes(32 if b in _STRIP else b for b in range(256))


@dataclass(frozen=True)
class Params:
    bits: int = 21
    alpha: float = 1.0      # learning rate
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 4
    rows: int = 8000        # bound of the labelled sample that is fitted
    stems: tuple[int, ...] = (4, 5)


def features(texts: Iterable[bytes], p: Params) -> Iterator[np.ndarray]:
    """Distinct coordinates of each text, as sorted int64 arrays."""
    for run in batches(texts):
        clean = [t.translate(_PUNCT_TO_SPACE) for t in run]
        words, at = word_hashes(clean)
        stems, stem_at = word_hashes([_stems(t, p.stems) for t in clean])
        pairs = combine([words[:-1], words[1:]]) if len(words) > 1 else words[:0]
        skips = combine([words[:-2], words[2:], words[2:] * U64(0) + U64(7)]) if len(words) > 2 else words[:0]
        shift = U64(64 - p.bits)
        words, pairs, skips = words >> shift, pairs >> shift, skips >> shift
        stems = mix(stems + U64(0x51)) >> shift
        for i in range(len(run)):
            a, b = at[i], at[i + 1]
            yield np.unique(np.concatenate([words[a:b], pairs[a:max(a, b - 1)], skips[a:max(a, b - 2)],
                                            stems[stem_at[i]:stem_at[i + 1]]])).astype(np.int64)


def _stems(text: bytes, sizes: tuple[int, ...]) -> bytes:
    words = set(text.lower().split())
    return b" ".join({w[:n] for n in sizes for w in words if len(w) >= n})


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate ``size`` is the bias (no L1)."""

    def __init__(self, p: Params):
        self.p = p
        self.n = np.zeros((1 << p.bits) + 1)
        self.z = np.zeros((1 << p.bits) + 1)

    def _l1(self, idx: np.ndarray) -> np.ndarray:
        return np.where(idx == 1 << self.p.bits, 0.0, self.p.l1)

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, l1 = self.z[idx], self._l1(idx)
        w = -(z - np.sign(z) * l1) / ((self.p.beta + np.sqrt(self.n[idx])) / self.p.alpha + self.p.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, idx: np.ndarray, label: int, weight: float) -> None:
        idx = np.append(idx, 1 << self.p.bits)
        w = self.weights(idx)
        g = weight * (sigmoid(w.sum()) - label)
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[idx] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit(texts: Iterable[bytes], labels: Iterable[int], p: Params = Params()) -> np.ndarray:
    """Weights (2**bits + 1 doubles, the bias last) from labelled texts."""
    model = Ftrl(p)
    seen = [(idx.astype(np.int32), int(y)) for idx, y in zip(features(texts, p), labels)]
    if not seen:
        return model.n
    count = {y: sum(1 for _, z in seen if z == y) for y in (0, 1)}
    scale = {y: float(np.sqrt(len(seen) / (2.0 * n))) for y, n in count.items() if n}
    for _ in range(p.epochs):
        for idx, y in seen:
            model.learn(idx, y, scale[y])
    return model.weights(np.arange((1 << p.bits) + 1))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> np.ndarray:
    """Weights from ``docs`` (id, text) and ``labels`` (id, label 0/1), both whole tables."""
    known = labels.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(p.rows)  # ids only; at most p.rows rows
    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [(t, y) for f in frames for t, y in zip(f["text"], f["label"])]
        w = fit((t.encode() for t, _ in sample), (y for _, y in sample), p)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at, "w": w[at]})

    one = (rows.withColumn("h", F.xxhash64("id")).repartition(1).sortWithinPartitions("h", "id", "label", "text")
           .select("text", "label"))
    learned = one.mapInPandas(run, "at long, w double").toPandas()
    weights = np.zeros((1 << p.bits) + 1)
    weights[learned["at"].to_numpy(dtype=np.int64)] = learned["w"].to_numpy(dtype=float)
    return weights


def score(docs: DataFrame, weights: np.ndarray, p: Params = Params()) -> DataFrame:
    """(id, score) of every row of (id, text); the weights are broadcast (2**bits + 1 doubles at most)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("toxicity")
        w = sent.value
        for f in frames:
            texts = (t.encode() if t else b"" for t in f["text"])
            s = np.array([w[idx].sum() for idx in features(texts, p)], dtype=float)
            yield pd.DataFrame({"id": f["id"], "score": sigmoid(s + w[-1]) if len(s) else s})

    return docs.select("id", "text").mapInPandas(run, "id long, score double")


def clean_rows(docs: DataFrame, text_col: str, weights: np.ndarray, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` whose text scores at most 0.5 (exactly 0.5: nothing was learned)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        w = sent.value
        for b in tables:
            texts = (t.encode() if t else b"" for t in b.column(at).to_pylist())
            s = np.array([w[idx].sum() for idx in features(texts, p)], dtype=float) + w[-1]
            yield b.filter(pa.array(s <= 0.0))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> "F.Column":
    """Rows whose crc32 of the id as text is divisible by 5 are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, label) of the ``toxic`` labels that may be learned from."""
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).filter(
        ~held_out(F.col("id")))
