"""Vectorised hashes of words, word windows and character n-grams, over batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Longer words are hashed one by one.
LONG_WORD = 64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_SEED = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chain(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    """The hash of what hashes to left followed by what hashes to right. Mixing after each step leaves no algebra by which
    structured inputs (repetitions, complements) cancel out."""
    return mix64(left * _ODD[which] + right)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word data[start:end], equal for equal bytes wherever they are.

    Words are read in lanes of eight bytes; those of more than LONG_WORD bytes are hashed by BLAKE2b.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = (ends - starts).astype(np.int64)
    both = tuple(mix64(sizes.astype(_U) + seed) for seed in _SEED)
    at, left, rows = starts, sizes, np.flatnonzero(sizes <= LONG_WORD)
    at, left = at[rows], left[rows]
    while len(rows):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (_U(1) << (left[short].astype(_U) << _U(3))) - _U(1)
        for which in (0, 1):
            both[which][rows] = chain(both[which][rows], lane, which)
        more = left > 8
        at, left, rows = at[more] + 8, left[more] - 8, rows[more]
    for i in np.flatnonzero(sizes > LONG_WORD):
        own = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        both[0][i], both[1][i] = int.from_bytes(own[:8], "little"), int.from_bytes(own[8:], "little")
    return both


class Words:
    """The words of a batch of texts: bytes `data`, where words start and end there, two independent hashes of each, and
    each text's range [first[i], first[i + 1]) of words. Words are runs of anything but the six ASCII white-space characters."""

    def __init__(self, texts: list[str | None]) -> None:
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a text, from the words' first or second hashes, and the word where each
        starts. Runs of 1, 2, 4 ... words are hashed from halves, and a run of k words from those that k is the sum of."""
        n = len(self.starts)
        ok = np.ones(max(0, n - k + 1), dtype=bool)
        for end in self.first[1:-1]:
            ok[max(0, end - k + 1) : end] = False
        at = np.flatnonzero(ok)
        values, size, place, power = None, k, 0, self.hashes[which]
        bit = 1
        while True:
            if size & bit:
                own = power[at + place]
                values = own if values is None else chain(values, own, which)
                place += bit
            if bit * 2 > size:
                break
            power = chain(power[:-bit], power[bit:], which) if len(power) > bit else power[:0]
            bit *= 2
            if not len(at):
                break
        return (values if values is not None else np.zeros(0, _U)), at

    def whole(self, i: int) -> np.ndarray:
        """The hash of all words of a (short) text, in an array of one."""
        value = np.zeros(1, _U)
        for h in self.hashes[0][self.first[i] : self.first[i + 1]]:
            value = chain(value, np.array([h], _U), 0)
        return value


def batches_of(rows: Iterator, size, most: int) -> Iterator[list]:
    """Consecutive rows in lists of about `most` by size(row), each list with a row at least."""
    batch, total = [], 0
    for row in rows:
        batch.append(row)
        total += size(row)
        if total >= most:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


def char_ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed n-grams of the lower-cased text's code points, with a space at either end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    run, out = points + _U(1), []
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(run) < 2:
                break
            run = run[:-1] * _U(0x100000001B3) + points[n - 1 :]
        if n in orders:
            out.append((((run ^ _U(n)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def word_ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed runs of words of the lower-cased text."""
    words = Words([text.lower()])
    out = [(words.windows(n)[0] ^ _U(n)) * _U(0x9E3779B97F4A7C15) >> _U(64 - bits) for n in orders if len(words.starts) >= n]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
