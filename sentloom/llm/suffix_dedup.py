"""Op 2. Repeated byte strings by suffix arrays built by two-stage sorting.

Whole texts can't meet in one place, so the corpus is cut into *regions* first. Each 400-byte string has a least
32-byte gram, which equal strings share; consecutive strings with the same gram form a segment, and all strings of a
segment contain one *core* of 209 bytes. Equal strings have equal cores. Fingerprints of cores are exchanged, and
only segments whose core repeats travel, as bytes and each once a bucket, to the owner of the core. There regions
with the same core get a suffix array: suffixes smaller than their successors are sorted directly, the rest induced
by bucket scans; neighbours with a common prefix of 400 bytes are repeats. A core that more than HOT segments hold is
not sent as bytes, since no task could take all its regions: its strings are compared by two independent 64-bit fingerprints
of all their bytes, each once a bucket; two different strings agree in both with a probability near 2**-120.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import BYTE, U, chunks, column, minimizers, mix, prefix, span, windows

GRAM = 32
SECOND = BYTE[256:512]  # other values of the 256 bytes, for a second fingerprint
HOT = 4096
BUCKET_BYTES = 8 << 20  # regions and their flags take several times a bucket's bytes
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
SEND = pa.schema([("_bucket", pa.int32()), ("owner", pa.int32()), ("hot", pa.bool_()), ("n", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()), ("regions", pa.binary())])
SEND_SQL = "_bucket int, owner int, hot boolean, n int, keys binary, lengths binary, counts binary, regions binary"
TELL = pa.schema([("_bucket", pa.int32()), ("owner", pa.int32()), ("hot", pa.bool_()), ("n", pa.int32()), ("answer", pa.binary())])
TELL_SQL = "_bucket int, owner int, hot boolean, n int, answer binary"


# ---- the suffix array -------------------------------------------------------------------------------------------


def _eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number."""
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
    return np.ascontiguousarray(rows).view(">u8").reshape(-1).astype(np.uint64)


def _direct(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their first `depth` bytes, ties by place; eight bytes a round, tied runs alone going on."""
    key = _eight(padded, at)
    order = np.argsort(key, kind="stable")
    out, key = at[order], key[order]
    tied = np.zeros(len(out), bool)
    same = key[1:] == key[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    slots = np.flatnonzero(tied)
    run = np.cumsum(np.concatenate([[True], ~same]))[slots] if len(out) else slots
    done = 8
    while len(slots) and done < depth:
        here = out[slots]
        key = _eight(padded, here + done)
        order = np.lexsort((key, run))
        here, key = here[order], key[order]
        out[slots] = here
        same = (key[1:] == key[:-1]) & (run[1:] == run[:-1])
        tied = np.zeros(len(slots), bool)
        tied[1:] |= same
        tied[:-1] |= same
        run = np.cumsum(np.concatenate([[True], ~same]))[tied]
        slots = slots[tied]
        done += 8
    return out


def two_stage(text: np.ndarray, need: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Suffix array of bytes: the places in `need` (all by default) in the order of their suffixes.

    A suffix smaller than its successor is sorted directly, to `depth` bytes; any other follows from its successor,
    whose first byte is not larger: buckets are scanned in ascending order, and what precedes a finished suffix with
    a byte at least as large takes the next free place in that byte's bucket. With a depth, suffixes equal over that
    many bytes may come in any order. An end of text is smaller than any byte.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    depth = n if depth is None else depth
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    step = np.empty(n, np.int8)  # sign of the next differing byte against this one
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    far = np.where(step != 0, np.arange(n), n)
    step = step[np.minimum.accumulate(far[::-1])[::-1]]
    small = step > 0
    if need is None:
        wanted = np.ones(n, bool)
    else:  # a suffix that is induced needs its successors up to one that is sorted
        stop = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
        at = np.flatnonzero(need)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, stop[at] + 1, -1)
        wanted = np.cumsum(edge[:-1]) > 0
    direct = _direct(padded, np.flatnonzero(small & wanted), depth)
    cuts = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1] and not small[n - 1]:  # the last suffix follows from the empty one
        waiting[text[n - 1]].append(np.array([n - 1]))
    result = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        bucket = []
        while len(level):  # runs of one byte are induced within their bucket
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~small[before] & wanted[before]]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        result.append(done)
        before = done[done > 0] - 1
        byte = text[before]
        ok = (byte > c) & ~small[before] & wanted[before]
        before, byte = before[ok], byte[ok]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        ends = np.flatnonzero(np.diff(byte, append=256 if len(byte) else 0)) if len(byte) else []
        begin = 0
        for e in ends:
            waiting[byte[e]].append(before[begin : e + 1])
            begin = e + 1
    order = np.concatenate(result) if result else np.empty(0, np.int64)
    return order if need is None else order[need[order]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to depth, that each suffix shares with the one before it in `order`; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    room = np.minimum(len(text) - order, depth)
    room = np.minimum(room[1:], room[:-1])
    alive, done = np.arange(len(order) - 1), 0
    got = np.zeros(len(order) - 1, np.int64)
    while len(alive) and done < depth:
        x = _eight(padded, order[alive] + done) ^ _eight(padded, order[alive + 1] + done)
        equal = x == 0
        part = x[~equal].astype(">u8").view(np.uint8).reshape(-1, 8)
        got[alive[~equal]] = done + (part != 0).argmax(1)
        got[alive[equal]] = done + 8
        alive = alive[equal]
        done += 8
    lcp[1:] = np.minimum(got, room)
    return lcp


# ---- segments ---------------------------------------------------------------------------------------------------


def _shape(width: int) -> tuple[int, int, int]:
    """(gram, strings a segment may have, core) for strings of `width` bytes."""
    gram = max(1, min(GRAM, width // 2))
    block = max(1, min(192, width // 2))
    return gram, block, width - block + 1


def _segments(data: np.ndarray, offsets: np.ndarray, i: int, j: int, width: int):
    """(first start, last start, key) of each segment of texts i..j; places count from the first byte of text i."""
    gram, block, core = _shape(width)
    lo = int(offsets[i])
    part = data[lo : int(offsets[j])]
    ends = np.repeat(offsets[i + 1 : j + 1] - lo, np.diff(offsets[i : j + 1]))
    n = len(part) - width + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return part, empty, empty, np.empty(0, U)
    at = np.flatnonzero(np.arange(n) + width <= ends[:n])
    if not len(at):
        return part, empty, empty, np.empty(0, U)
    sums = prefix(BYTE[part])
    least = minimizers(windows(sums, gram), width - gram + 1)[at]
    piece = (least - at) // block
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(least) != 0) | (np.diff(piece) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begin = least[first] - block * piece[first]
    key = mix(span(sums, begin, begin + core) + piece[first].astype(U))
    return part, at[first], at[last], key


class _Bucket:
    """A bucket's segments in a fixed order, the same in every round."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.data, self.offsets = column(table.column(X.TEXT))
        self.chunks, lo, hi, key, of = [], [], [], [], []
        for i, j in chunks(self.offsets):
            _, a, b, k = _segments(self.data, self.offsets, i, j, width)
            base = int(self.offsets[i])
            lo.append(a + base)
            hi.append(b + base)
            key.append(k)
            of.append(np.full(len(k), len(self.chunks)))
            self.chunks.append((i, j))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        self.lo, self.hi, self.key, self.of = cat(lo, np.int64), cat(hi, np.int64), cat(key, U), cat(of, np.int64)
        self.keys, self.which, self.count = np.unique(self.key, return_inverse=True, return_counts=True)

    def regions(self, code: np.ndarray):
        """Distinct regions of the segments with code 1: (segments, number of each one's region, bytes, keys, counts).
        They are numbered by key, then bytes: the rows of a bucket come in another order whenever a task reads them anew."""
        segs = np.flatnonzero(code[self.which] == 1)
        segs = segs[np.argsort(self.key[segs], kind="stable")]
        seen: dict[tuple[int, bytes], int] = {}
        number = np.empty(len(segs), np.int64)
        raw = self.data
        for x, s in enumerate(segs):
            number[x] = seen.setdefault((int(self.key[s]), raw[self.lo[s] : self.hi[s] + self.width].tobytes()), len(seen))
        ordered = sorted(seen)
        place = np.empty(len(seen), np.int64)
        place[np.fromiter((seen[r] for r in ordered), np.int64, len(seen))] = np.arange(len(seen))
        number = place[number]
        keys = np.fromiter((k for k, _ in ordered), U, len(seen))
        return segs, number, [r for _, r in ordered], keys, np.bincount(number, minlength=len(seen))

    def hot(self, code: np.ndarray):
        """Strings of the segments with code 2: (places, two fingerprints of each)."""
        segs = np.flatnonzero(code[self.which] == 2)
        places, prints, others = [], [], []
        for c, (i, j) in enumerate(self.chunks):
            own = segs[self.of[segs] == c]
            if len(own):
                base = int(self.offsets[i])
                part = self.data[base : int(self.offsets[j])]
                n = self.hi[own] - self.lo[own] + 1
                at = np.repeat(self.lo[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                places.append(at)
                prints.append(mix(span(prefix(BYTE[part]), at - base, at - base + self.width) ^ np.repeat(self.key[own], n)))
                others.append(span(prefix(SECOND[part]), at - base, at - base + self.width))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        return cat(places, np.int64), cat(prints, U), cat(others, U)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, number of the pair at each place, how often each pair occurs) of the distinct pairs, by a and then b."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[new], y[new], which, np.bincount(which, minlength=int(new.sum()))


def _codes(said: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(blob for _, blob in X.by_owner(said)), np.uint8)


def _decide(regions: list[bytes], keys: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each distinct region, which of its strings repeat in it, in another, or because the region itself does."""
    flags = [np.full(len(r) - width + 1, counts[x] > 1) for x, r in enumerate(regions)]
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else []
    batch: list[int] = []
    size = 0

    def run(batch: list[int]) -> None:
        text = np.frombuffer(b"".join(regions[x] for x in batch), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(regions[x]) for x in batch])])
        need = np.zeros(len(text), bool)
        for x, b in zip(batch, begin):
            need[b : b + len(flags[x])] = True
        order = two_stage(text, need, width)
        lcp = adjacent_prefixes(text, order, width)
        hit = np.zeros(len(text), bool)
        twin = np.flatnonzero(lcp >= width)
        hit[order[twin]] = True
        hit[order[twin - 1]] = True
        for x, b in zip(batch, begin):
            flags[x] |= hit[b : b + len(flags[x])]

    for a, b in zip(cuts, np.append(cuts[1:], len(order)) if len(order) else []):
        if b - a > 1:
            batch += order[a:b].tolist()
            size += sum(len(regions[x]) for x in order[a:b])
            if size > 1 << 20:
                run(batch)
                batch, size = [], 0
    if batch:
        run(batch)
    return flags


def _covered(start: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of marked starts of strings: how many run bounds each text has, these (from the text's first byte), and which bytes are covered."""
    seen = np.cumsum(start, dtype=np.int32)
    seen[width:] -= seen[:-width].copy() if len(seen) > width else seen[:0]
    gone = seen > 0
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    inner = bounds[1:-1]
    same = np.unique(inner[(inner > 0) & (inner < len(gone))])
    both = same[gone[same] & gone[same - 1]]  # a run that reaches a text's end ends there
    edges = np.sort(np.concatenate([edges, both, both]))
    starts, ends = edges[0::2], edges[1::2]
    of = np.searchsorted(bounds, starts, "right") - 1
    flat = np.empty(2 * len(starts), np.int64)
    flat[0::2], flat[1::2] = starts - bounds[of], ends - bounds[of]
    return np.bincount(of, minlength=len(bounds) - 1) * 2, flat, gone


# ---- the operator -----------------------------------------------------------------------------------------------


def suffix_dedup(docs: DataFrame, width: int = 400, hot: int = HOT) -> DataFrame:
    """Removes every byte covered by a string of `width` bytes that also starts anywhere else, the same text included.

    Texts are UTF-8 bytes; strings never cross texts, overlaps count, and all copies go. Returns doc_id, n_bytes, spans
    (starts and ends of the maximal removed runs, flat) and kept (the remaining bytes, which need not be valid UTF-8),
    one row for each input row. A null or empty text has no bytes; texts shorter than `width` stay whole. Repeated rows
    are texts of their own, so their strings repeat. Other columns are ignored. Strings in segments whose core more than `hot`
    segments have are equal when two independent 64-bit fingerprints are.
    """
    n = X.buckets_for(docs, BUCKET_BYTES)
    rows = X.bucketed(docs, n)
    owners = n

    def ask_cores(table: pa.Table) -> pa.Table:
        b = _Bucket(table, width)
        return X.asks(table.column(X.BUCKET)[0].as_py(), b.keys, owners, np.minimum(b.count, 65535).astype(np.uint16))

    def own_cores(table: pa.Table) -> pa.Table:
        keys, cuts, extra = X.received(table)
        _, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=np.frombuffer(b"".join(extra), np.uint16))
        code = ((total > 1).astype(np.uint8) + (total > hot))[which]
        return X.answers(table, [code[a:b].astype(np.uint8).tobytes() for a, b in zip(cuts[:-1], cuts[1:])])

    def send(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SEND.empty_table()
        bucket = table.column(X.BUCKET)[0].as_py()
        b, code = _Bucket(table, width), _codes(said)
        out = []
        _, _, regions, keys, counts = b.regions(code)
        who, cuts = X.split(keys, owners)
        lengths = np.fromiter(map(len, regions), np.int32, len(regions))
        for o, x, y in zip(who, cuts[:-1], cuts[1:]):
            out.append((bucket, int(o), False, int(y - x), keys[x:y].tobytes(), lengths[x:y].tobytes(), np.minimum(counts[x:y], 2).astype(np.uint8).tobytes(), b"".join(regions[x:y])))
        prints, others, _, counts = _distinct(*b.hot(code)[1:])
        who, cuts = X.split(prints, owners)
        for o, x, y in zip(who, cuts[:-1], cuts[1:]):
            out.append((bucket, int(o), True, int(y - x), prints[x:y].tobytes(), None, np.minimum(counts[x:y], 2).astype(np.uint8).tobytes(), others[x:y].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), SEND)], schema=SEND) if out else SEND.empty_table()

    def judge(table: pa.Table) -> pa.Table:
        spread = table.column("hot").to_numpy(zero_copy_only=False).astype(bool)
        keys = [np.frombuffer(x, U) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()]
        result: list[bytes] = [b""] * table.num_rows
        rows_hot = np.flatnonzero(spread)
        if len(rows_hot):
            others = [np.frombuffer(table.column("regions")[int(r)].as_py(), U) for r in rows_hot]
            _, _, which, _ = _distinct(np.concatenate([keys[r] for r in rows_hot]), np.concatenate(others))
            total = np.bincount(which, weights=np.concatenate([counts[r] for r in rows_hot]))
            cuts = np.concatenate([[0], np.cumsum([len(keys[r]) for r in rows_hot])])
            for r, x, y in zip(rows_hot, cuts[:-1], cuts[1:]):
                result[r] = np.packbits(total[which[x:y]] > 1).tobytes()
        seen: dict[bytes, int] = {}
        numbers, all_keys, total = {}, [], []
        for r in np.flatnonzero(~spread):
            lengths = np.frombuffer(table.column("lengths")[r].as_py(), np.int32)
            blob, at, own = table.column("regions")[r].as_py(), 0, []
            for k, length, c in zip(keys[r].tolist(), lengths.tolist(), counts[r].tolist()):
                x = seen.setdefault(blob[at : at + length], len(seen))
                if x == len(total):
                    total.append(0)
                    all_keys.append(k)
                total[x] += c
                at += length
                own.append(x)
            numbers[r] = own
        flags = _decide(list(seen), np.array(all_keys, U), np.array(total, np.int64), width)
        for r, own in numbers.items():
            result[r] = np.packbits(np.concatenate([flags[x] for x in own])).tobytes()
        return pa.table([table.column(c).cast(TELL.field(c).type) for c in ("_bucket", "owner", "hot", "n")] + [pa.array(result, pa.binary())], schema=TELL)

    def remove(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        level = said.column("level").to_numpy()
        b, code = _Bucket(table, width), _codes(said.filter(pa.array(level == 1)))
        told = said.filter(pa.array(level == 2))
        is_hot = told.column("hot").to_numpy(zero_copy_only=False).astype(bool) if told.num_rows else np.empty(0, bool)
        segs, number, regions, keys, _ = b.regions(code)
        sizes = np.fromiter((len(r) - width + 1 for r in regions), np.int64, len(regions))
        del regions
        _, cuts = X.split(keys, owners)
        flags = [np.unpackbits(np.frombuffer(blob, np.uint8), count=int(sizes[x:y].sum())) for (_, blob), x, y in zip(X.by_owner(told.filter(pa.array(~is_hot))), cuts[:-1], cuts[1:])]
        flags = np.concatenate(flags) if flags else np.empty(0, np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)])[number]  # of each segment
        order = np.argsort(segs)
        segs, begin = segs[order], begin[order]
        places, prints, others = b.hot(code)
        found = np.empty(0, np.uint8)
        if len(places):
            which = _distinct(prints, others)[2]
            found = X.bits(told.filter(pa.array(is_hot)))[which].astype(np.uint8)
        counts, runs, kept, left = [], [], [], []
        for i, j in b.chunks:  # strings stay within their text, so a chunk of texts at a time does
            lo, hi = int(b.offsets[i]), int(b.offsets[j])
            start = np.zeros(hi - lo, np.uint8)
            x, y = np.searchsorted(b.lo[segs], [lo, hi])
            for s, f in zip(segs[x:y], begin[x:y]):
                start[b.lo[s] - lo : b.hi[s] - lo + 1] = flags[f : f + b.hi[s] - b.lo[s] + 1]
            x, y = np.searchsorted(places, [lo, hi])
            start[places[x:y] - lo] = found[x:y]
            bounds = b.offsets[i : j + 1] - lo
            per, flat, gone = _covered(start, bounds, width)
            counts.append(per)
            runs.append(flat)
            kept.append(b.data[lo:hi][~gone])
            left.append(np.diff(np.concatenate([[0], np.cumsum(~gone)])[bounds]))
        ends = lambda xs, t: pa.array(np.concatenate([[0], np.cumsum(np.concatenate(xs))]), t)
        spans = pa.ListArray.from_arrays(ends(counts, pa.int32()), pa.array(np.concatenate(runs), pa.int64()))
        body = pa.Array.from_buffers(pa.binary(), table.num_rows, [None, ends(left, pa.int32()).buffers()[1], pa.py_buffer(np.concatenate(kept))])
        return pa.table([table.column(X.DOC).cast(pa.int64()), pa.array(np.diff(b.offsets), pa.int64()), spans, body], schema=OUT)

    cores = X.owned(rows.groupBy(X.BUCKET).applyInArrow(ask_cores, X.ASK), own_cores)
    sent = rows.groupBy(X.BUCKET).cogroup(cores.groupBy(X.BUCKET)).applyInArrow(send, SEND_SQL)
    judged = sent.groupBy("owner").applyInArrow(judge, TELL_SQL)
    said = cores.select("_bucket", "owner", F.lit(False).alias("hot"), "n", "answer", F.lit(1).alias("level")).unionByName(judged.withColumn("level", F.lit(2)))
    return rows.groupBy(X.BUCKET).cogroup(said.groupBy(X.BUCKET)).applyInArrow(remove, "doc_id long, n_bytes long, spans array<long>, kept binary")
