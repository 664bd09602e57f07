"""Vectorised word and shingle hashing over whole batches of texts (numpy, no loop per word).

Texts are UTF-8 bytes with A-Z lower-cased; words are runs of bytes other than space and
0x09-0x0D. A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum
over the batch, then mixed; a shingle's hash is a mixed linear form of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
BATCH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = (np.arange(256, dtype=np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 (a bijection of 64-bit values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BATCH_BYTES, 1 << (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, offsets): words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[_LOWER[buf]] * up[:len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begin)


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes (A-Z lower-cased) of each run buf[start:end], independent of where the run stands."""
    up, down = _power_tables(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[_LOWER[buf]] * up[:len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Cut a sequence of texts into runs of about BATCH_BYTES (one longer text is a run alone)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > BATCH_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def _coefficients(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * U64(0x632BE59BD9B4E019)) | U64(1)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash from several per-position hashes, order-sensitive."""
    c = _coefficients(len(parts) + 1)
    acc = np.full(len(parts[0]), c[-1], dtype=np.uint64)
    for k, p in zip(c, parts):
        acc = acc + p * k
    return mix(acc)


def shingle_sets(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words; a text with fewer words
    has its whole word sequence as one shingle, a text without words none."""
    for run in batches(texts):
        words, at = word_hashes(run)
        n = max(0, len(words) - width + 1)
        grams = combine([words[i:i + n] for i in range(width)]) if n else words[:0]
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                yield np.unique(grams[a:b - width + 1])
            elif b > a:
                yield combine([words[i:i + 1] for i in range(a, b)])
            else:
                yield words[:0]
