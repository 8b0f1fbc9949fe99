"""Words and strings of many texts at once, as numpy arrays: places and 64-bit hashes.

Bytes are read eight at a time and mixed after each step, so that no algebra of the bytes (such as that of a polynomial
in one base) carries over to the hashes. Two lanes start from different numbers and together are a hash of 128 bits."""

from __future__ import annotations

import hashlib

import numpy as np

SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_U = np.uint64
#: Words of more bytes are hashed one by one.
_LONG = 256
#: For 0 to 8 bytes, which bits of eight loaded bytes count.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Where lanes start, and odd numbers that tell the first of two joined hashes from the second.
_SEED = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))
_FIRST = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def joined(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = a * _FIRST[lane]
    x += b
    return mixed(x)


def loads(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """data[i:i+8] as a number for every i but the last seven; a view, not a copy."""
    return np.ndarray((max(0, len(data) - 7),), kind, data, strides=(1,))


def runs(values: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of values[i:i+n] for every i, by doubling."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, step, now = None, 0, 1, values
    while True:
        if n & step:  # the parts of n in binary, the smaller first
            part = now[done : done + m]
            out, done = (part if out is None else joined(out, part, lane)), done + step
        if done == n:
            return mixed(out + _U(n))
        now, step = joined(now[:-step], now[step:], lane), 2 * step


class Words:
    """Words (runs of other bytes than white space) of some texts, in order; of: each word's text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
        gap = np.empty(len(self.data) + 1, dtype=np.int8)
        gap[0] = 1
        gap[1:] = _IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(gap))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        self.first = np.searchsorted(self.starts, begins)  # of each text
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.of = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word; words of up to eight bytes of one length never share one."""
        eight, size = loads(self.data), self.ends - self.starts
        out = mixed(_SEED[lane] + size.astype(np.uint64))
        some, at, left = np.arange(len(size)), self.starts, size
        while len(some):
            out[some] = mixed((out[some] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _FIRST[lane])
            more = (left > 8) & (size[some] <= _LONG)
            some, at, left = some[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > _LONG).tolist():
            whole = hashlib.blake2b(self.data[self.starts[k] : self.ends[k]].tobytes(), digest_size=16).digest()
            out[k] = np.frombuffer(whole, np.uint64)[lane]
        return out

    def windows(self, n: int, *lanes: int) -> tuple[np.ndarray, ...]:
        """(text, first word, a hash for each lane) of every run of n words of one text."""
        m = max(0, len(self.of) - n + 1)
        inside = self.of[:m] == self.of[n - 1 :][:m]
        of = self.of[:m][inside]
        return of, np.flatnonzero(inside) - self.first[of], *(runs(self.hashes(k), n, k)[inside] for k in lanes)
