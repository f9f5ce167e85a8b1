"""Character n-grams of words and their buckets (fastText's scheme), as column expressions, and for all words of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NGRAMS = 40


def char_ngrams(word: Column, min_n: int = 3, max_n: int = 6) -> Column:
    """n-grams of `<word>`, by start and then length."""
    e = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.length(e)
    sizes = F.sequence(F.lit(min_n), F.lit(max_n))
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(sizes, lambda k: i + k - 1 <= n), lambda k: e.substr(i, k))))


def _fnv_of(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [a, b), all of them a byte at a time."""
    out = np.full(len(a), 2166136261, np.uint32)
    signed = data.view(np.int8).astype(np.int32).view(np.uint32)
    order = np.argsort(a - b, kind="stable")  # the longest first, so that those still going are the first ones
    begin, size = a[order], (b - a)[order]
    going = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    part = out[order]
    for k, n in enumerate(going.tolist()):
        part[:n] = (part[:n] ^ signed[begin[:n] + k]) * np.uint32(16777619)
    out[order] = part
    return out


def _fnv(gram: pa.Array) -> pa.Array:
    text = gram.cast(pa.large_string()).fill_null("")
    _, offsets, data = text.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.array(_fnv_of(data, cuts[:-1], cuts[1:]).astype(np.int64), mask=gram.is_null().to_numpy(zero_copy_only=False))


def fnv(gram: Column) -> Column:
    """32-bit FNV-1a in which bytes from 0x80 on are sign-extended, as a long. In Arrow: the recursion over bytes has no built-in expression."""
    return F.arrow_udf(_fnv, "long")(gram)


def buckets(word: Column, bucket: int, min_n: int = 3, max_n: int = 6, most: int = MAX_NGRAMS) -> Column:
    """Bucket of each of the word's first `most` n-grams."""

    @F.arrow_udf("array<long>")
    def run(words: pa.Array) -> pa.Array:
        of, ids = hashed_ngrams(words.fill_null("").to_pylist(), bucket, min_n, max_n, most)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))]), pa.int32()), pa.array(ids))

    return run(word)


def hashed_ngrams(words: list[str], bucket: int, min_n: int = 3, max_n: int = 6, most: int = MAX_NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each of the words' first `most` n-grams, as buckets() has them: all words in one step."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    head = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    word = np.searchsorted(ends, head, "right")
    first = np.searchsorted(head, np.concatenate([[0], ends[:-1]]))
    size = np.diff(np.append(first, len(head)))
    place = np.arange(len(head)) - first[word]
    left = np.minimum(size[word] - place, max_n)  # characters from here that an n-gram may have
    fits = np.maximum(left - min_n + 1, 0)
    before = np.cumsum(fits) - fits
    begin = np.repeat(np.arange(len(head)), fits)
    length = np.arange(int(fits.sum())) - np.repeat(before, fits) + min_n
    of = word[begin]
    rank = np.arange(len(of)) - before[first[of]]
    keep = rank < most
    begin, length, of = begin[keep], length[keep], of[keep]
    stop = np.append(head, len(data))
    a, b = stop[begin], stop[begin + length]
    return of, (_fnv_of(data, a, b) % np.uint32(bucket)).astype(np.int64)
