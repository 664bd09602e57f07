"""Phrase collocation mining: suffix pointers routed by leading words, counted by multikey three-way quicksort.

Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and 0x0A-0x0D, pieces into words at space and tab. A suffix is
the run of up to five words that starts at a word and stays in its piece; a phrase's count is the number of suffixes it leads.

1. **Leading words.** Tasks count their words and word pairs, Spark sums them. A phrase can only be frequent if all its
   pairs are, so the frequent pairs go into a bit table of fixed size (2**25 bits, two positions a pair: no frequent
   pair is ever missed, a false hit only sends a suffix in vain).
2. **Routing.** Each suffix is cut before its first pair that is not in the table; what is left of two words or more
   (equal ones of a task counted together) is routed by range over (language, leading words): a
   hot leading word or pair is spread over many partitions by the words behind it.
3. **Multikey quicksort.** Each partition sorts pointers to its suffixes: three-way split by one word, the equal part goes on
   with the next word. The weight of an equal part is the count of the phrase that leads it; parts below the minimum are
   abandoned at once. Only the first and last suffix of a partition can have fellows next door, so parts that hold one
   of them are told with whatever count they have, and Spark sums these few.
4. **Scores** by joins of the frequent phrases with themselves: each cut's two parts are frequent too. Numbers are exact
   (decimals of 38 digits). The lookups are salted, since one word may lead a third of all phrases.

Memory: a task holds some million words or suffixes, never a language, a word's suffixes or the corpus.

Defined results: null texts are empty, a null language is ``und``; repeated rows count each time; texts of any length are
read whole; empty tables and texts without words give no row; further columns are never read. Ties of scores go to the larger
count, then to the smaller phrase in the order of its UTF-8 bytes. Words and suffixes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyhall.llm.common import written
from studyhall.llm.hashing import U64, batches, combine, mix, run_hashes

LONGEST = 5
TABLE_BITS = 25
BUFFER = 1 << 22        # bytes of text that a task holds before it counts their words
SLICE = 1 << 16         # rows that a task hands over at once
PARTITION = 1 << 20     # suffixes in a partition, on average
SALTS = 16
END = -1 << 63          # behind the last word of a shorter suffix

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _language(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))


class Words:
    """Texts of one language and, once hashed, their words: hashes, piece numbers and where their bytes are."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.bufs: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def hashed(self) -> bool:
        """Cut all texts into words; whether there are any."""
        pieces = 0
        for run in batches(self.texts):
            raw = b"\n".join([b"", *run, b""])
            buf = np.frombuffer(raw, dtype=np.uint8)
            kind = _CLASS[buf]
            edge = np.flatnonzero((kind[1:] > 0) != (kind[:-1] > 0)) + 1
            starts, ends = edge[0::2], edge[1::2]
            if len(starts):
                piece = np.cumsum(kind == 2)[starts] + pieces
                pieces = int(piece[-1]) + 1
                self.parts.append((run_hashes(buf, starts, ends), piece.astype(np.int32),
                                   np.full(len(starts), len(self.bufs), dtype=np.int32), starts, ends))
                self.bufs.append(raw)
        return bool(self.parts)

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts)]

    def text(self, at: np.ndarray, columns: list[np.ndarray]) -> list[str]:
        _, _, buf, starts, ends = columns
        return [self.bufs[b][s:e].lower().decode() for b, s, e in zip(buf[at], starts[at], ends[at])]


def _buffered(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Words]]:
    """The rows of a task in runs of some BUFFER bytes, by language."""
    held: dict[str, Words] = {}
    size = 0

    def full():
        for lang, words in held.items():
            if words.hashed():
                yield lang, words
        held.clear()

    for f in frames:
        for lang, text in zip(f["lang"], f["text"]):
            held.setdefault(lang, Words()).texts.append(text.encode())
            size += len(text) + 1
            if size > BUFFER:
                yield from full()
                size = 0
    yield from full()


def _pairs(lang: str, hashes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each pair of neighbours, whether both are in one piece)."""
    seed = np.full(len(hashes) - 1, _language(lang), dtype=np.uint64)
    return combine([seed, hashes[:-1], hashes[1:]]), piece[:-1] == piece[1:]


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, i + SLICE) for i in range(0, n, SLICE))


def leading_counts(docs: DataFrame) -> DataFrame:
    """Counts per buffer of the tasks: words (lang, word, key, n), pairs (null, null, key, n) and numbers of words
    (lang, null, any key, n). A word or pair has one row a buffer, however often it occurs, so no key is hot."""
    def run(frames):
        for i, (lang, words) in enumerate(_buffered(frames)):
            columns = words.columns()
            hashes, piece = columns[:2]
            yield pd.DataFrame({"lang": [lang], "word": [None], "key": [i % 256], "n": [len(hashes)]})
            keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
            for at in _slices(len(keys)):
                yield pd.DataFrame({"lang": lang, "word": words.text(first[at], columns), "key": keys[at].view(np.int64),
                                    "n": n[at]})
            if len(hashes) > 1:
                keys, same = _pairs(lang, hashes, piece)
                keys, n = np.unique(keys[same], return_counts=True)
                for at in _slices(len(keys)):
                    yield pd.DataFrame({"lang": None, "word": None, "key": keys[at].view(np.int64), "n": n[at]})
    return docs.mapInPandas(run, "lang string, word string, key long, n long")


def _positions(keys):
    low = U64((1 << TABLE_BITS) - 1)
    return keys & low, (keys >> U64(32)) & low


def bit_table(pairs: DataFrame) -> np.ndarray:
    """The keys (column ``key``) as 2**TABLE_BITS bits: 4 MB whatever the corpus."""
    low = (1 << TABLE_BITS) - 1
    at = F.explode(F.array(F.col("key").bitwiseAND(low), F.shiftrightunsigned("key", 32).bitwiseAND(low))).alias("at")
    bits = pairs.select(at).groupBy(F.shiftright("at", 5).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 5), dtype=np.uint32)
    table[bits["slot"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table


def _in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for at in _positions(keys):
        found &= (table[(at >> U64(5)).astype(np.int64)] >> (at & U64(31)).astype(np.uint32) & 1).astype(bool)
    return found


def suffixes(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(lang, w1 .. w5, n): suffixes cut before their first pair that is surely infrequent, two words at least."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = [f"w{i + 1}" for i in range(LONGEST)]

    def run(frames):
        for lang, words in _buffered(frames):
            hashes, piece = words.columns()[:2]
            if len(hashes) < 2:
                continue
            keys, same = _pairs(lang, hashes, piece)
            same[same] = _in_table(sent.value, keys[same])
            at = np.flatnonzero(same)
            if not len(at):
                continue
            goes = np.ones(len(at), dtype=bool)
            rows = [hashes[at].view(np.int64)]
            for i in range(1, LONGEST):
                goes = goes & (at + i - 1 < len(same)) & same[np.minimum(at + i - 1, len(same) - 1)]
                rows.append(np.where(goes, hashes[np.minimum(at + i, len(hashes) - 1)].view(np.int64), END))
            _, first, n = np.unique(combine([r.view(np.uint64) for r in rows]), return_index=True, return_counts=True)
            for part in _slices(len(first)):
                yield pd.DataFrame({"lang": lang, **{k: r[first[part]] for k, r in zip(names, rows)}, "n": n[part]})
    return docs.mapInPandas(run, "lang string, " + ", ".join(f"{k} long" for k in names) + ", n long")


def equal_parts(keys: list[np.ndarray], weight: np.ndarray, minimum: int) -> Iterator[tuple[int, int, int]]:
    """(pointer to one suffix, depth, weight) of every part of suffixes with equal keys up to ``depth``, by multikey
    three-way quicksort of pointers. Parts lighter than ``minimum`` are abandoned unless they hold the least or the
    greatest suffix of all."""
    edge = np.zeros(len(weight), dtype=bool)
    for end in (np.min, np.max):
        at = np.arange(len(weight))
        for key in keys if len(at) else []:
            at = at[key[at] == end(key[at])]
        edge[at] = True
    stack = [(np.arange(len(weight)), 0)] if len(weight) else []
    while stack:
        at, depth = stack.pop()
        if int(weight[at].sum()) < minimum and not edge[at].any():
            continue
        key = keys[depth][at]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        below, above = key < pivot, key > pivot
        for part in (at[below], at[above]):
            if len(part):
                stack.append((part, depth))
        same = at[~(below | above)]
        total = int(weight[same].sum())
        if pivot == END or (total < minimum and not edge[same].any()):
            continue
        yield int(same[0]), depth, total
        if depth + 1 < len(keys):
            stack.append((same, depth + 1))


def phrase_counts(found: DataFrame, minimum: int) -> DataFrame:
    """(lang, words, n): phrases of two words or more, ``n`` >= minimum, from (lang, w1 .. w5, n)."""
    names = [f"w{i + 1}" for i in range(LONGEST)]
    n_parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + found.count() // PARTITION)

    def run(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        code, langs = pd.factorize(rows["lang"], sort=True)
        keys = [code.astype(np.int64), *[rows[k].to_numpy(dtype=np.int64) for k in names]]
        told = [(langs[code[at]], [int(k[at]) for k in keys[1:depth + 1]], n)
                for at, depth, n in equal_parts(keys, rows["n"].to_numpy(dtype=np.int64), minimum) if depth >= 2]
        if told:
            yield pd.DataFrame(told, columns=["lang", "words", "n"])
    sorted_ = found.repartitionByRange(n_parts, "lang", *names).mapInPandas(run, "lang string, words array<long>, n long")
    return sorted_.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= minimum)


def _looked_up(rows: DataFrame, key, facts: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``value`` of ``facts`` (lang, key, value), rows of one key dealt over SALTS copies of its fact."""
    salted = facts.select(F.col("lang").alias("f_lang"), F.col("key").alias("f_key"), F.col(value).alias(name),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)).cast("int")).withColumn("at", key)
    return rows.join(salted, (F.col("lang") == F.col("f_lang")) & (F.col("at") == F.col("f_key"))
                     & (F.col("salt") == F.col("f_salt"))).drop("f_lang", "f_key", "f_salt", "salt", "at")


def collocations(docs: DataFrame, *, minimum: int = 100, inside_percent: int = 100, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from docs (lang, text): phrases of two to five words that occur
    ``minimum`` times at least, less those that lie in a longer one that occurs ``inside_percent`` as often at least;
    the first ``top`` of each language (None: all)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # Dealt out by key before the sums: the tasks have counted each buffer, another table of counts there would only take memory.
    leads = leading_counts(docs).repartition("key").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    leads = written(leads.filter((F.col("n") >= minimum) | (F.col("lang").isNotNull() & F.col("word").isNull())), "leads")
    table = bit_table(leads.filter("lang is null"))
    phrases = written(phrase_counts(written(suffixes(docs, table), "suffixes"), minimum), "phrases")

    words = leads.filter("word is not null")
    totals = leads.filter("lang is not null and word is null").groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", F.lit(True).alias("key"), "n")
    counts = phrases.select("lang", F.col("words").alias("key"), "n").unionByName(
        words.select("lang", F.array("key").alias("key"), "n"))

    inner = phrases.filter(F.size("words") > 2).select("lang", "n", "words", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> "
        "transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")).alias("part"))
    longer = inner.groupBy("lang", F.col("part").alias("words")).agg(F.max("n").alias("longer"))
    kept = phrases.withColumnRenamed("n", "a").join(longer, ["lang", "words"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent)).drop("longer")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = _looked_up(cuts, F.expr("slice(words, 1, k)"), counts, "n", "l")
    cuts = _looked_up(cuts, F.expr("slice(words, k + 1, size(words) - k)"), counts, "n", "r")
    cuts = _looked_up(cuts, F.lit(True), totals, "n", "n")
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spelled = _looked_up(scored.select("*", F.posexplode("words").alias("pos", "part")), F.col("part"), words, "word", "word")
    named = spelled.groupBy("lang", "words", "a", "n", "cut").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
        .alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    out = named.withColumn("rank", rank)
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS (SELECT lang, i, words, unnest(range(1, 6)) AS m FROM i
), f AS (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM g WHERE i + m - 1 <= len(words) GROUP BY ALL
), t AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON b.lang = s.lang AND b.m > s.m AND 100 * b.a >= 100 * s.a
   AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
), cut AS (
  SELECT c.lang, c.phrase, c.a, k.k, array_to_string(words[1:k.k], ' ') AS head, array_to_string(words[k.k + 1:m], ' ') AS tail
  FROM c JOIN (SELECT unnest(range(1, 5)) AS k) k ON k.k < c.m
  WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase)
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, h.f AS l, r.f AS r, t.n,
         (1000::HUGEINT * cut.a * t.n::HUGEINT) // (h.f::HUGEINT * r.f) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = cut.head JOIN f r ON r.lang = cut.lang AND r.phrase = cut.tail
  JOIN t ON t.lang = cut.lang
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM s
), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o WHERE rank <= 2000
"""
