"""Op 3. Best-fit packing with swap-based local search.

Texts become token ids without a shuffle; only (piece, length) rows are packed. Groups of pieces are packed apart:
best fit over descending lengths, then a local search among the underfull bins. Full bins are final. All others are
opened again and their pieces packed in new groups, until one group is left.
"""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import BYTE, prefix, span, trim

# ---- tokens -----------------------------------------------------------------------------------------------------

KNOWN = 0x250  # code points below are classified here; a text with others goes to the library as a whole
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    import regex

    out = np.full(KNOWN, OTHER, np.uint8)
    for c in range(KNOWN):
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            if regex.fullmatch(pattern, chr(c)):
                out[c] = kind
    return out


def _merger(path: str):
    """bytes of a piece -> ids by byte-pair ranks, or None where the file's merges aren't in the order of their ids. The
    library's own merges give the same, at ten times the cost."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], model.get("merges", [])
    order = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
    used = {bytes([b]) for b in range(256)} | {bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in merges}
    if order != sorted(set(order)) or -1 in order or min(order, default=0) < 256 or any(bytes([b]) not in ranks for b in range(256)) or model.get("ignore_merges"):
        return None
    ranks = {k: v for k, v in ranks.items() if k in used}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Tokens:
    """Byte-level BPE ids of texts, as the tokenizers library gives them. Its merges never cross the pieces into which its
    pattern splits a text, so distinct pieces are encoded once and remembered by fingerprint."""

    def __init__(self, path: str, remember: int = 1 << 18):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = False
        self.merge = _merger(path)
        self.classes = _classes()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}  # of a piece's fingerprint
        self.begin = np.zeros(1 << 16, np.int64)
        self.pool = np.empty(1 << 18, np.uint32)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        ids = [self.merge(w.encode("utf-8", "surrogatepass")) for w in words] if self.merge else [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, m = len(self.index), int(sizes.sum())
        used = int(self.begin[n])
        while n + len(ids) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.begin[n + 1 : n + len(ids) + 1] = used + np.cumsum(sizes)
        self.pool[used : used + m] = np.fromiter((i for x in ids for i in x), np.uint32, m)
        self.index.update(zip(keys, range(n, n + len(ids))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        import re

        apostrophe = re.compile("'(?:s|t|re|ve|m|ll|d)")
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        plain = [i for i, (t, p) in enumerate(zip(texts, points)) if len(p) and p.max() < KNOWN and not ("'" in t and apostrophe.search(t)) and not any(s in t for s in self.special)]
        out: list = [None] * len(texts)
        fast = set(plain)
        slow = [i for i in range(len(texts)) if i not in fast]
        for i, e in zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False) if slow else []):
            out[i] = np.array(e.ids, np.uint32)
        at, size = [], 0
        for i in plain:
            at.append(i)
            size += len(points[i])
            if size > 1 << 18 or i == plain[-1]:
                for k, ids in zip(at, self._fast([points[k] for k in at])):
                    out[k] = ids
                at, size = [], 0
        return out

    def _fast(self, points: list[np.ndarray]) -> list[np.ndarray]:
        text = np.concatenate(points)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in points])])
        n = len(text)
        kind = self.classes[text]
        edge = np.zeros(n + 1, bool)  # of the texts
        edge[bounds] = True
        begin = edge[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        last = blank.copy()  # white space right before something else of the same text
        last[:-1] &= ~blank[1:]
        last &= ~edge[1:]
        # such white space leaves its run; a space then joins what follows, any other stands alone
        begin |= last
        joins = np.flatnonzero(last & (text == 32))
        begin[joins + 1] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        keys = span(prefix(BYTE[text]), start, end)
        new, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = new.tolist()
        if len(self.index) > self.remember:  # memory is bounded; what is needed again is encoded again
            self._forget()
        todo = [x for x, k in enumerate(new) if k not in self.index]
        if todo:
            raw = text.tobytes()
            self._learn([new[x] for x in todo], [raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(start[first[todo]].tolist(), end[first[todo]].tolist())])
        place = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))[which]
        size = self.begin[place + 1] - self.begin[place]
        shift = self.begin[place] - (np.cumsum(size) - size)
        ids = self.pool[np.arange(int(size.sum())) + np.repeat(shift, size)]
        cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@functools.lru_cache(4)
def tokens_of(path: str) -> Tokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokens(path)


PIECES = "doc_id long, row string, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, longest: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every row's token ids, each followed by end_id: at most `longest` ids each; of a longer text the first
    piece takes the remainder. `row` tells apart rows that repeat a doc_id."""
    names = PIECES + (", ids binary" if with_ids else "")
    schema = [("doc_id", pa.int64()), ("row", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        tool = tokens_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out = []
                for doc, ids in zip(some.column(0).to_pylist(), tool.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    raw = ids.tobytes()
                    name = f"{part}.{seen}"
                    seen += 1
                    begin, k = 0, 0
                    stop = (len(ids) - 1) % longest + 1
                    while begin < len(ids):
                        own = raw[4 * begin : 4 * stop]
                        out.append((doc, name, k, begin, stop - begin, zlib.crc32(own)) + ((own,) if with_ids else ()))
                        begin, stop, k = stop, stop + longest, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        trim()

    return X.corpus(docs).mapInArrow(run, names)


# ---- bins -------------------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: descending lengths, each into the fullest bin with room. A bit for each amount of room finds it at once."""
    bins: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = 0
    for x in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = lengths[x]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                rooms &= ~(1 << room)
            bins[b].append(x)
            room -= n
        else:
            b, room = len(bins), capacity - n
            bins.append([x])
        if room:
            at[room].append(b)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, tries: int = 64, seed: int = 7) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins, each of which increases the sum of squared
    fills; bins that become empty go. Bins that are full stay as they are. In a round each bin tries `tries` fuller ones at random; rounds
    follow one another until one gains nothing (each gain is a whole number, so they end)."""
    fill = [sum(lengths[x] for x in b) for b in bins]
    loose = [b for b in range(len(bins)) if fill[b] < capacity]
    rnd = random.Random(seed)
    while True:
        gained = False
        loose = sorted((b for b in loose if 0 < fill[b] < capacity), key=lambda b: fill[b])
        if len(loose) < 2:
            break
        for low in loose:  # the emptiest give to fuller ones
            if not bins[low] or fill[low] == capacity:
                continue
            for _ in range(tries):
                high = loose[rnd.randrange(len(loose))]
                if high == low or not bins[high] or fill[high] < fill[low] or fill[high] == capacity or not bins[low]:
                    continue
                room, best = capacity - fill[high], None
                mine = sorted(bins[low], key=lambda x: lengths[x])
                for a, x in enumerate(mine):  # what `high` gains: by a move, or by giving y for x, or y for x and z
                    if lengths[x] <= room and (best is None or lengths[x] > best[0]):
                        best = (lengths[x], (x,), ())
                    for y in bins[high]:
                        gain = lengths[x] - lengths[y]
                        if 0 < gain <= room and (best is None or gain > best[0]):
                            best = (gain, (x,), (y,))
                        for z in mine[a + 1 :]:
                            gain = lengths[x] + lengths[z] - lengths[y]
                            if gain > room:
                                break
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, (x, z), (y,))
                if best:
                    gain, give, take = best
                    bins[low] = [x for x in bins[low] if x not in give] + list(take)
                    bins[high] = [x for x in bins[high] if x not in take] + list(give)
                    fill[low] -= gain
                    fill[high] += gain
                    gained = True
        if not gained:
            break
    return [b for b in bins if b]


GROUP = 1 << 16  # pieces that are packed together
PACKED = "row string, piece int, grp long, bin long, offset long, fill long, length long"


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows of (row, piece, length): pieces into as few sequences of `capacity` as found.

    Groups of about GROUP pieces are packed apart. The pieces of all bins that aren't full then form new groups, level by level, until
    one group holds them all or more than half of them are left open again."""
    parts = X.cut(parts)
    n = parts.count()
    groups = max(1, -(-n // GROUP))
    schema = pa.schema([("row", pa.string()), ("piece", pa.int32()), ("grp", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("length", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        bins.sort(key=lambda b: -sum(lengths[x] for x in b))
        order = np.array([x for b in bins for x in b], np.int64)
        size = np.asarray(lengths, np.int64)[order]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        fill = np.bincount(number, weights=size).astype(np.int64)
        before = np.cumsum(size) - size
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]).astype(np.int64)
        group = table.column("grp")[0].as_py()
        cols = [table.column("row").take(order), table.column("piece").take(order), pa.array(np.full(len(order), group)), pa.array(number), pa.array(before - before[first][number]), pa.array(fill[number]), pa.array(size)]
        return pa.table(cols, schema=schema)

    slim = parts.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("grp"))
    final, level = [], 0
    while True:
        packed = slim.groupBy("grp").applyInArrow(run, PACKED)
        packed = X.cut(packed.withColumn("level", F.lit(level)))
        if groups == 1:
            final.append(packed)
            break
        final.append(packed.where(F.col("fill") >= capacity))
        rest = packed.where(F.col("fill") < capacity)
        left = rest.count()
        if left == 0:
            break
        if 2 * left > n:
            final.append(rest)
            break
        n, groups, level = left, max(1, -(-left // GROUP)), level + 1
        slim = rest.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(groups)).alias("grp"))
    done = functools.reduce(DataFrame.unionByName, final)
    # levels, groups and bins as one number
    name = (F.col("level").cast("long") * (1 << 58) + F.col("grp") * (1 << 20) + F.col("bin")).alias("sequence_id")
    return parts.join(done.select("row", "piece", name, "offset"), ["row", "piece"])


def pack_documents(docs: DataFrame, vocabulary: str, longest: int = 2048) -> DataFrame:
    """Packs all texts into sequences of at most `longest` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Rows that repeat a doc_id are packed each for itself. A text longer
    than a sequence is cut into pieces of `longest`, the first of which takes the remainder. Other columns are ignored.
    """
    return pack(pieces(docs, vocabulary, longest), longest).drop("row")
