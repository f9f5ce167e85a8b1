"""Plain versions of the queries' contracts, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix(rows, width=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def substring(rows, window=13):
    first = {}
    low = lambda d: -math.inf if d is None else d
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, math.inf), low(d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < low(d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def lines(rows, chars=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    low = lambda d: -math.inf if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(low(d))
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= chars and len(held[key(x)]) >= docs and low(d) < max(held[key(x)]))]
        out.append((d, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return out


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    best = {t: max((x for x in g if x is not None), default=None) for t, g in groups.items()}
    return [(d, best[t or ""], len(groups[t or ""]), d == best[t or ""], sha(t or "")) for d, t in rows]


def shingles(t, width=2):
    w = WORD.findall((t or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_roots(rows, width=2, percent=80):
    """(sets, of each row a row of its component)."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted((i for i in range(len(rows)) if sets[i]), key=lambda i: len(sets[i]))
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def near(rows, width=2, percent=80):
    sets, root = near_roots(rows, width, percent)
    low = lambda d: -math.inf if d is None else d
    best = {}
    for i, (d, _) in enumerate(rows):
        r = root[i]
        best[r] = d if r not in best or low(d) < low(best[r]) else best[r]
    return [(d, len(sets[i]), best[root[i]], d == best[root[i]]) for i, (d, _) in enumerate(rows)]


def held(d, folds):
    return zlib.crc32(("" if d is None else str(d)).encode()) % folds == 0


def unigram(rows, folds=10, add=0.1):
    toks = [WORD.findall((t or "").translate(UPPER)) + [None] for _, t in rows]
    c = Counter(x for (d, _), w in zip(rows, toks) if not held(d, folds) for x in w)
    n, v = sum(c.values()), len(c)
    return [(d, held(d, folds), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + add) / (n + add * (v + 1))) for x in w)) for (d, _), w in zip(rows, toks)]


def contaminated(rows, items, parts_of, threshold, overlap, k1=1.2, b=0.75):
    """(doc_id, item_id, score, question overlap, answer overlap): every passage of every text against every item."""
    split = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    items = [(i, t) for i, t in items if t is not None]
    bags = [Counter(split(t)) for _, t in items]
    df = Counter(x for bag in bags for x in bag)
    size = [sum(bag.values()) for bag in bags]
    mean = max(1.0, sum(size) / len(size))
    impact = []
    for bag, n in zip(bags, size):
        own = {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * n / mean)) for x, c in bag.items()}
        total = sum(own.values()) or 1.0
        impact.append({x: v / total for x, v in own.items()})
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    parts = []
    for _, t in items:
        q, a = map(split, parts_of(t))
        parts.append([(grams(w, n), n) for w, n in ((q, min(3, max(1, len(q)))), (a, min(3, max(1, len(a)))))])
    stride = max(64, max(size))
    out = []
    for d, t in rows:
        w = split(t)
        best = {}
        for k in range(max(1, -(-len(w) // stride) - 1)):
            passage = w[k * stride : (k + 2) * stride]
            held = set(passage)
            for i, own in enumerate(impact):
                score = sum(v for x, v in own.items() if x in held)
                if score < threshold - 1e-9 or not own:
                    continue
                share = [len(g & grams(passage, n)) / len(g) if g else 1.0 for g, n in parts[i]]
                if min(share) >= overlap:
                    best[i] = max(best.get(i, (0, 0, 0)), (score, *share))
        out += [(d, items[i][0], *(round(x, 6) for x in found)) for i, found in best.items()]
    return out


def shards(rows, n, hash_of):
    """(doc_id, crc32, shard) by one running sum of bytes over groups of equal texts in the order of their hashes; of each crc32 its group's place."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    total = sum(len(g) * (len(t.encode()) + 1) for t, g in groups.items())
    out, place, start = [], {}, 0
    for k, t in enumerate(sorted(groups, key=hash_of)):
        size = len(groups[t]) * (len(t.encode()) + 1)
        crc = zlib.crc32(t.encode())
        place[crc] = k
        out += [(d, crc, min(n - 1, (2 * start + size) * n // (2 * total))) for d in groups[t]]
        start += size
    return out, place
