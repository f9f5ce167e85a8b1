"""Vectorised text kernels: everything here works on the bytes of an Arrow column, never on single rows.

Fingerprints are polynomial in 2**64 over randomly mapped symbols, followed by a bijective mixer, so equal
sequences always agree and different ones collide with probability near 2**-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.mapped import trim  # noqa: F401

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 2**64, 1 << 10, dtype=U) | U(1)  # one odd value for every byte or small code point
LOWER = BYTE[:256].copy()
LOWER[65:91] = BYTE[97:123]
MUL = int(_RNG.integers(1, 2**63)) * 8 + 5  # 5 mod 8: the longest period
MUL &= 2**64 - 1
INV = pow(MUL, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCT = SPACE.copy()  # separators where words are letters, digits and non-ASCII alone
PUNCT[:128] |= ~np.array([chr(c).isalnum() for c in range(128)])
CHUNK = 256 << 10  # bytes that one vectorised step takes (its arrays then stay in cache), unless a single text is longer

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) in 2**64; kept for the process while short."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.ones(max(n, CHUNK + 1), U)
    size, step = 1, base & (2**64 - 1)
    while size < len(out):
        out[size : 2 * size] = out[: min(size, len(out) - size)] * U(step)
        step = step * step & (2**64 - 1)
        size *= 2
    if len(out) <= 64 * CHUNK:
        _powers[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Running sums from which span() takes the fingerprint of any range. symbols: uint64."""
    out = np.empty(len(symbols) + 1, U)
    out[0] = 0
    np.cumsum(symbols * powers(MUL, len(symbols)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed fingerprints of the ranges [start, end)."""
    return mix((sums[end] - sums[start]) * powers(INV, len(sums))[start])


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Mixed fingerprints of all ranges of one width, in order."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * powers(INV, len(sums))[:n]) if n > 0 else np.empty(0, U)


def column(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges [i, j) of texts of about limit bytes at most, one text at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """The words of texts i..j of a column: start and end (in `data`), their text's number and fingerprints."""

    __slots__ = ("data", "start", "end", "doc", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False, space: np.ndarray = SPACE):
        lo, hi = int(offsets[i]), int(offsets[j])
        self.data = data[lo:hi]
        bounds = offsets[i : j + 1] - lo
        n = hi - lo
        inside = ~space[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] |= inside[cut]  # a text's end also ends its last word
        ends[cut - 1] |= inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)  # of each text, its first word; last: how many there are
        self.doc = np.repeat(np.arange(j - i), np.diff(self.first))
        table = LOWER if lower else BYTE
        self.hash = span(prefix(table[self.data]), self.start, self.end) if n else np.empty(0, U)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the sequences of k words from each word, and whether these stay within their text."""
        n = len(self)
        out = windows(prefix(self.hash), k)
        ok = self.doc[k - 1 :] == self.doc[: n - k + 1] if n >= k else np.empty(0, bool)
        return out, ok


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values; log2(width) passes."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each run of `width` hashes the place of the least, the leftmost of several."""
    n = len(hashes)
    bits = U(max(1, n.bit_length()))
    tagged = (hashes >> bits << bits) | np.arange(n, dtype=U)
    return (sliding_min(tagged, width) & ((U(1) << bits) - U(1))).astype(np.int64)


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted uint64 values as Golomb codes with a power of two: (remainder bits, unary part, remainders)."""
    n = len(values)
    if not n:
        return 0, b"", b""
    gaps = np.diff(values, prepend=U(0))
    mean = max(1, int(values[-1]) // n)
    r = max(0, mean.bit_length() - 1)
    quotient = (gaps >> U(r)).astype(np.int64) if r else gaps.astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, bool)
    unary[np.cumsum(quotient + 1) - 1] = True
    rest = b""
    if r:
        bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - r :]
        rest = np.packbits(bits.reshape(-1)).tobytes()
    return r, np.packbits(unary).tobytes(), rest


def rice_decode(n: int, r: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.empty(0, U)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(U) << U(r) if r else (np.diff(ones, prepend=-1) - 1).astype(U)
    if r:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - r :] = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * r).reshape(n, r)
        gaps |= np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(U)
    return np.cumsum(gaps)
