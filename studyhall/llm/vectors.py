"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on ``m`` fixed random lines. Two vectors of cosine ``c`` differ by
sqrt(2 - 2c) times a standard normal on every line, so a window of ``z`` such deviations around a
query holds a linked vector on a known share of the lines. Pairs that collide on at least
``threshold()`` lines, the count calibrated to the wanted recall, are verified by their cosine in
double precision.

The first projection is sorted into slabs of about ``slab_rows`` vectors (bounds: one number per
slab). Only slabs that a window reaches meet, two at a time and in tasks of their own, each of
bounded size; inside such a task the collisions on all lines are counted tile by tile. Equal vectors
are one node with a multiplicity. A task returns link counts per vector and the edges of a spanning
forest of the links it found, never its pairs.

Defined results: null vectors, empty ones, zero ones and those with null, NaN or infinite
components link with nothing; vectors of different lengths never link; repeated rows count as
vectors of their own; a null id takes part like any other but its component is the smallest non-null
id (null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyhall.llm.common import written
from studyhall.llm.graph import components

LINES = 12
DEVIATIONS = 2.5
SLAB_DEVIATIONS = 3.5
RECALL = 0.999
SLAB_ROWS = 1500
TILE = 256


def within(z: float) -> float:
    return math.erf(z / math.sqrt(2.0))


def threshold(m: int = LINES, z: float = DEVIATIONS, recall: float = RECALL) -> int:
    """The largest count that a pair at the cosine threshold reaches with probability ``recall``."""
    p, tail = within(z), 0.0
    for count in range(m, 0, -1):
        tail += math.comb(m, count) * p ** count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 1


def lines(dim: int, m: int = LINES) -> np.ndarray:
    return np.random.default_rng(20_000 + dim).standard_normal((dim, m))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _parse(vectors: DataFrame, kind: str) -> DataFrame:
    """(id, key, dim, p, vec): key and p (first projection) null for vectors that link with nothing."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, dims, first, raw = [], [], [], []
            for v in f["vec"]:
                x = None
                if v is not None and len(v) and not any(c is None for c in v):
                    x = np.asarray(v, dtype=np.float64)
                    norm = math.sqrt(float((x * x).sum())) if np.isfinite(x).all() else 0.0
                    x = x if 0.0 < norm < math.inf else None
                if x is None:
                    keys.append(None), dims.append(None), first.append(None), raw.append(None)
                    continue
                b = (x + 0.0).astype(kind).tobytes()
                keys.append(hashlib.blake2b(b, digest_size=16).digest())
                dims.append(len(x))
                first.append(float(x @ lines(len(x))[:, 0] / norm))
                raw.append(b)
            yield pd.DataFrame({"id": f["id"], "key": keys, "dim": dims, "p": first, "vec": raw})
    return vectors.mapInPandas(run, "id long, key binary, dim int, p double, vec binary")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node index reachable from each of ``n`` nodes over edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(left: np.ndarray, right: np.ndarray, same: bool, cosine: float, m: int, z: float, count: int):
    """Index pairs (rows of left, rows of right) that collide often enough and reach the cosine."""
    a = lines(left.shape[1], m)
    p, q = (left @ a).astype(np.float32), (right @ a).astype(np.float32)
    width = np.float32(z * math.sqrt(2 - 2 * cosine))
    out_a, out_b = [], []
    for at in range(0, len(left), TILE):
        hits = np.zeros((len(p[at:at + TILE]), len(q)), dtype=np.int8)
        for k in range(m):
            hits += np.abs(p[at:at + TILE, k, None] - q[None, :, k]) <= width
        x, y = np.nonzero(hits >= count)
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        for c in range(0, len(x), 1 << 16):
            i, j = x[c:c + (1 << 16)], y[c:c + (1 << 16)]
            ok = np.einsum("ij,ij->i", left[i], right[j]) >= cosine
            out_a.append(i[ok])
            out_b.append(j[ok])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def near_vectors(vectors: DataFrame, *, cosine: float = 0.95, m: int = LINES, z: float = DEVIATIONS,
                 recall: float = RECALL, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(id, n_links, component) per row of ``vectors`` (id, vec array of float or double)."""
    element = vectors.schema["vec"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = written(_parse(vectors.select("id", "vec"), kind), "vectors")
    nodes = written(rows.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"),
        F.first("dim").alias("dim"), F.first("p").alias("p")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    slabs = max(1, -(-n // slab_rows))
    bounds = np.unique(nodes.approxQuantile("p", [i / slabs for i in range(1, slabs)], 0.2 / slabs)
                       if slabs > 1 else [])
    reach = SLAB_DEVIATIONS * math.sqrt(2 - 2 * cosine)
    # Slab i meets slabs i .. last[i]: the nearest point of a later slab is its lower bound.
    last = np.searchsorted(bounds, bounds + reach, side="right") if len(bounds) else np.empty(0, dtype=int)
    last = np.append(last, len(bounds))
    first = np.array([int(np.searchsorted(last[:j + 1], j)) for j in range(len(last))])
    sent = nodes.sparkSession.sparkContext.broadcast((bounds, first, last))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, lo, hi = sent.value
        for f in frames:
            slab = np.searchsorted(edges, f["p"].to_numpy(), side="right")
            yield f.drop(columns="p").assign(slab=slab, lo=lo[slab], hi=hi[slab])

    placed = nodes.select("node", "dim", "copies", "vec", "p").mapInPandas(
        place, "node long, dim int, copies long, vec binary, slab int, lo int, hi int")
    rest = ["node", "copies", "vec"]
    as_left = placed.select("dim", F.col("slab").alias("i"), F.explode(F.sequence("slab", "hi")).alias("j"),
                            F.lit(0).alias("side"), *rest)
    as_right = placed.filter("lo < slab").select(
        "dim", F.explode(F.sequence(F.col("lo"), F.col("slab") - 1)).alias("i"), F.col("slab").alias("j"),
        F.lit(1).alias("side"), *rest)
    count = threshold(m, z, recall)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        same = bool(frame["i"].iloc[0] == frame["j"].iloc[0])
        right = left if same else right
        columns = ["a", "b", "links"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        x, y = _links(_unit(left["vec"].tolist(), kind), _unit(right["vec"].tolist(), kind), same, cosine, m, z, count)
        ids = left["node"].to_numpy() if same else np.concatenate([left["node"], right["node"]])
        copies = left["copies"].to_numpy() if same else np.concatenate([left["copies"], right["copies"]])
        y = y if same else y + len(left)
        found = np.zeros(len(ids), dtype=np.int64)
        np.add.at(found, x, copies[y])
        np.add.at(found, y, copies[x])
        label = _forest(x, y, len(ids))
        at = np.flatnonzero(found)
        return pd.DataFrame({"a": ids[at], "b": ids[label[at]], "links": found[at]})

    met = written(as_left.unionByName(as_right).groupBy("dim", "i", "j").applyInPandas(
        meet, "a long, b long, links long"), "met")
    links = met.groupBy("a").agg(F.sum("links").alias("links"))
    of = components(met.select("a", "b"), "vector-components")
    nodes = (nodes.select("key", "node", "least", "copies").join(of.withColumnRenamed("id", "node"), "node", "left")
             .join(links.withColumnRenamed("a", "node"), "node", "left")
             .select("key", "least", F.coalesce("component", "node").alias("class"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = nodes.groupBy("class").agg(F.min("least").alias("component"))
    nodes = nodes.join(least, "class").select("key", "n_links", "component")
    return rows.select("id", "key").join(nodes, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
