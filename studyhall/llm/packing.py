"""Best-fit packing with a grouping genetic algorithm, distributed as islands.

``tokenize`` cuts every document (its token ids, then an end id) into pieces of at most ``capacity``
tokens; only documents longer than that are cut. ``pack`` deals the pieces over shards by a hash of
their row and lets several islands evolve a packing of each shard in tasks of their own. A
chromosome is a list of bins (groups of pieces). Crossover injects the best-filled bins of one
parent into the other, removes the bins there that now hold duplicates and best-fits the displaced
pieces by length; mutation dissolves the emptiest bins. Between epochs each island's elite migrates
to the next island of the ring. Bins of the winning elite that are filled well are final, and where
those hold less than half of a level's pieces, the next best filled ones up to half; the pieces of
the others go on to the next level. So each level deals over fewer shards, until one shard is left.
No task ever holds more than about ``shard_rows`` pieces per island, whatever the table's size.

Tokenizing a word depends on the word alone (the pre-tokenizer never joins across white space), so a
task keeps the ids of the words it has met, in a bounded table.

Defined results: null text is empty; an empty text is one piece that holds the end id; repeated
rows are packed each on their own; a null id is packed like any other; no rows, no pieces.
"""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.llm.common import worker_state, written

CAPACITY = 2048
SHARD_ROWS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 4
FILLED = 0.98
WORDS_KEPT = 700_000      # entries of the word table inside a task
WORDS_HANDED_ON = 250_000  # of them, what a worker keeps for its next task
RUN_CHARS = 1 << 20

# Printable ASCII and Latin letters: stable under NFC, lower-cased alike everywhere (but for U+0130).
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*").fullmatch


class WordEncoder:
    """text -> its ids as little-endian 32-bit bytes, through word tables of bounded size.

    The file's normalizer and pre-tokenizer act on each white-space separated word alone. Words of
    plain Latin letters, digits and signs are lower-cased and cut here by the file's own pattern,
    and many new pieces at once go through its merges; every other word goes through the whole
    tokenizer.
    """

    def __init__(self, path: str, kept: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        self.whole = Tokenizer.from_file(path)
        self.pieces_of = regex.compile(split["pattern"]["Regex"]).findall
        size = 1 + max(spec["model"]["vocab"].values())
        self.raw = [i.to_bytes(4, "little") for i in range(size)]
        self.last = [False] * size
        for token, i in spec["model"]["vocab"].items():
            self.last[i] = token.endswith(spec["model"]["end_of_word_suffix"])
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.kept = kept

    def _cut(self, word: str) -> list[str]:
        """Pieces of a plain word; letters with at most one closing sign need no pattern."""
        if word.isalpha():
            return [word.lower()]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1]]
        return self.pieces_of(word.lower())

    def _learn(self, new: list[str]) -> None:
        cut = {}
        for w in new:
            if _PLAIN(w) and "<|" not in w:
                cut[w] = self._cut(w)
            else:
                ids = self.whole.encode(w, add_special_tokens=False).ids
                self.words[w] = b"".join([i.to_bytes(4, "little") for i in ids])
        of = self.pieces
        unknown = list({p for parts in cut.values() for p in parts if p not in of})
        if unknown:
            if len(of) + len(unknown) > self.kept:
                of = self.pieces = dict(islice(of.items(), self.kept // 2))
                unknown = list({p for parts in cut.values() for p in parts if p not in of})
            ids = self.merges.encode_batch_fast([" ".join(unknown)], add_special_tokens=False)[0].ids
            raw, last, run, done = self.raw, self.last, b"", []
            for i in ids:
                run += raw[i]
                if last[i]:
                    done.append(run)
                    run = b""
            of.update(zip(unknown, done))
        for w, parts in cut.items():
            self.words[w] = of[parts[0]] if len(parts) == 1 else b"".join([of[p] for p in parts])

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts, their new words learned together."""
        known = self.words
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new: set[str] = set()
        for parts in split:
            new.update(filterfalse(known.__contains__, parts))
        if new:
            if len(known) + len(new) > self.kept:
                # the words met first are mostly the common ones: they stay
                known = self.words = dict(islice(known.items(), self.kept // 2))
                new = {w for parts in split for w in parts if w not in known}
            self._learn(list(new))
        of = known.__getitem__
        return [b"".join(map(of, parts)) for parts in split]

    def trim(self, kept: int) -> None:
        """Free all but the entries learned first, mostly the common words and pieces."""
        self.words = dict(islice(self.words.items(), kept))
        self.pieces = dict(islice(self.pieces.items(), kept))

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def _encoder(path: str, kept: int) -> WordEncoder:
    state = worker_state("packing")
    if path not in state:
        state[path] = WordEncoder(path, kept)
    return state[path]


def _runs(ids, texts) -> Iterator[list[tuple]]:
    """Rows in runs of about RUN_CHARS characters of text."""
    run, size = [], 0
    for row in zip(ids, texts):
        run.append((row[0], row[1] or ""))
        size += len(run[-1][1])
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def tokenize(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) per piece of ``docs`` (id, text)."""
    end = end_id.to_bytes(4, "little")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, WORDS_KEPT)
        for f in frames:
            out = []
            for rows in _runs(f["id"], f["text"]):
                for (id_, _), ids in zip(rows, encode.many([t for _, t in rows])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        out.append((id_, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])
        encode.trim(WORDS_HANDED_ON)
    return docs.select("id", "text").mapInPandas(
        run, "id long, piece int, start long, length long, ids_crc32 long")


class Room:
    """Open bins by free space; the smallest sufficient space is the lowest set bit of a mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.bins = capacity, 0, {}

    def put(self, free: int, bin_: list) -> None:
        if free:
            self.bins.setdefault(free, []).append(bin_)
            self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, list] | None:
        m = self.mask >> size
        if not m:
            return None
        free = size + (m & -m).bit_length() - 1
        stack = self.bins[free]
        bin_ = stack.pop()
        if not stack:
            self.mask ^= 1 << free
        return free, bin_


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], fills: list[int], capacity: int):
    """Add ``items`` in the given order, each to the bin it fills best; bins are [members]."""
    room = Room(capacity)
    at = {}
    for b, fill in zip(bins, fills):
        at[id(b)] = fill
        room.put(capacity - fill, b)
    for i in items:
        size = sizes[i]
        got = room.take(size)
        if got is None:
            b = [i]
            bins.append(b)
            at[id(b)] = size
            room.put(capacity - size, b)
        else:
            free, b = got
            b.append(i)
            at[id(b)] += size
            room.put(free - size, b)
    return bins, [at[id(b)] for b in bins]


def fitness(fills: list[int], capacity: int) -> float:
    """Mean squared filling: prefers few bins, and full ones beside empty ones."""
    return sum(f * f for f in fills) / (len(fills) * capacity * capacity) if fills else 1.0


def cross(a, b, sizes, capacity, rng):
    """Child of two packings ([bins, fills]): the best-filled bins of ``b`` enter ``a``."""
    (a_bins, a_fills), (b_bins, b_fills) = a, b
    order = sorted(range(len(b_bins)), key=lambda i: -b_fills[i])
    share = order[:max(1, int(len(order) * rng.uniform(0.2, 0.6)))]
    bins, fills = [list(b_bins[i]) for i in share], [b_fills[i] for i in share]
    inside = {x for x_bin in bins for x in x_bin}
    displaced = []
    for bin_, fill in zip(a_bins, a_fills):
        if inside.isdisjoint(bin_):
            bins.append(list(bin_))
            fills.append(fill)
        else:
            displaced += [x for x in bin_ if x not in inside]
    displaced.sort(key=lambda x: (-sizes[x], x))
    return best_fit(sizes, displaced, bins, fills, capacity)


def mutate(a, sizes, capacity, rng):
    """Dissolve some of the emptiest bins and a few others, and best-fit their pieces."""
    bins, fills = a
    order = sorted(range(len(bins)), key=lambda i: fills[i])
    gone = set(order[:max(1, len(order) // 20)]) | set(rng.sample(order, max(1, len(order) // 50)))
    left = [x for i in gone for x in bins[i]]
    rng.shuffle(left)
    left.sort(key=lambda x: -sizes[x])
    kept = [i for i in range(len(bins)) if i not in gone]
    return best_fit(sizes, left, [list(bins[i]) for i in kept], [fills[i] for i in kept], capacity)


def evolve(sizes: list[int], seeds: list, capacity: int, rng: random.Random, *, population: int = POPULATION,
           generations: int = GENERATIONS):
    """Best packing found from ``seeds`` (packings) and best-fit starts in perturbed order."""
    people = list(seeds)
    while len(people) < population:
        noise = 0.0 if not people else 0.15
        key = [-s * (1 + noise * rng.random()) for s in sizes]
        people.append(best_fit(sizes, sorted(range(len(sizes)), key=key.__getitem__), [], [], capacity))
    least = -(-sum(sizes) // capacity)
    score = lambda p: fitness(p[1], capacity)
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(people[0][0]) <= least:
            break
        young = [mutate(cross(people[rng.randrange(population // 2)], people[rng.randrange(population)], sizes,
                              capacity, rng), sizes, capacity, rng) for _ in range(population // 2)]
        people = sorted(people + young, key=score, reverse=True)[:population]
    return people[0]


def _bins_of(group: pd.Series, index: dict) -> list[list[int]]:
    out: dict = {}
    for rid, b in zip(group.index, group):
        out.setdefault(b, []).append(index[rid])
    return list(out.values())


_SOLUTION = "shard long, island int, origin int, rid long, length long, bin long"


def _epoch(capacity: int, epoch: int):
    """Evolve one island of one shard from the elites it received (rows with bin) or from nothing."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(k) for k in key)
        items = frame[["rid", "length"]].drop_duplicates().sort_values("rid")
        rids, sizes = items["rid"].tolist(), items["length"].tolist()
        index = {r: i for i, r in enumerate(rids)}
        seeds = []
        for _, g in frame[frame["bin"] >= 0].sort_values(["origin", "rid"]).groupby("origin"):
            bins = _bins_of(g.set_index("rid")["bin"], index)
            seeds.append((bins, [sum(sizes[x] for x in b) for b in bins]))
        bins, _ = evolve(sizes, seeds, capacity, random.Random(shard * 1009 + island * 31 + epoch))
        of = [0] * len(rids)
        for n, b in enumerate(bins):
            for x in b:
                of[x] = n
        return pd.DataFrame({"shard": shard, "island": island, "origin": island, "rid": rids, "length": sizes, "bin": of})
    return run


def _level(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    """(rid, length, shard, bin) of the best island of each shard."""
    dealt = items.select(F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(shards)).alias("shard"), "rid", "length")
    start = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.lit(-1).alias("origin"), "rid", "length", F.lit(-1).cast("long").alias("bin"))
    found = start.groupBy("shard", "island").applyInPandas(_epoch(capacity, 0), _SOLUTION)
    for epoch in range(1, epochs):
        ring = found.select("shard", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands))))
                            .alias("island"), "origin", "rid", "length", "bin")
        found = ring.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), _SOLUTION)
    found = written(found, "islands")
    bins = found.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    best = (bins.groupBy("shard", "island").agg(F.count("*").alias("n"), F.sum(F.col("fill") * F.col("fill")).alias("q"))
            .groupBy("shard").agg(F.min(F.struct("n", (-F.col("q")).alias("q"), "island")).alias("best"))
            .select("shard", F.col("best.island").alias("island")))
    return found.join(best, ["shard", "island"]).select("rid", "length", "shard", "bin")


def _least_fill(fill: DataFrame, pieces: int, capacity: int) -> float:
    """The filling from which bins of a level are final: ``FILLED``, or less if those bins hold less than half
    of the level's pieces. Without it a table of texts that fill no sequence together would never end."""
    held = 0
    for row in sorted(fill.groupBy("fill").agg(F.sum("n").alias("n")).collect(), reverse=True):
        held += row["n"]
        if 2 * held >= pieces:
            return min(FILLED * capacity, row["fill"])
    return 0


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to capacity) plus sequence_id and offset (gapless from 0).

    Pieces that fill a sequence alone are final at once. Sequence numbers are unique, not dense.
    """
    pieces = written(pieces.withColumn("__rid", F.monotonically_increasing_id()), "pieces")
    alone = pieces.filter(F.col("length") >= capacity).select(
        F.col("__rid").alias("rid"), (-1 - F.col("__rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity).select(F.col("__rid").alias("rid"), "length")
    final, level = alone, 0
    while True:
        n = left.count()
        if not n:
            break
        shards = -(-n // shard_rows)
        level += 1
        found = written(_level(left, shards, capacity, islands, epochs, level), "packed")
        fill = found.groupBy("shard", "bin").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
        if shards == 1:
            done = found
        else:
            good = fill.filter(F.col("fill") >= _least_fill(fill, n, capacity)).select("shard", "bin")
            done = found.join(good, ["shard", "bin"], "left_semi")
            left = written(found.join(good, ["shard", "bin"], "left_anti").select("rid", "length"), "left")
        number = (F.lit(level) * (1 << 52)) + F.col("shard") * (1 << 20) + F.col("bin")
        placed = done.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("x"))
        placed = placed.select(number.alias("sequence_id"), F.posexplode("x").alias("k", "p"), "x").select(
            F.col("p.rid").alias("rid"), "sequence_id",
            F.aggregate(F.slice("x", 1, F.col("k")), F.lit(0).cast("long"), lambda s, e: s + e["length"]).alias("offset"))
        final = final.unionByName(placed)
        if shards == 1:
            break
    return pieces.join(final.withColumnRenamed("rid", "__rid"), "__rid").drop("__rid")
