"""Op 5. Repeated word windows by level-wise doubling.

A window of `window` words that repeats has repeated parts. The first level looks at sequences of a few words, and of these
only at the least-fingerprinted one in each window, which equal windows share: a sequence that one document alone has rules
out every window around it. Windows whose sequence repeats go to the next level, of twice the words (or one less), until
`window` is reached or no candidates survive: a bucket without candidates sends nothing more. Every level is one
exchange of sorted fingerprints, each once a bucket; the answers are single bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import Words, chunks, column, minimizers, trim

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
LOWEST = -(2**63)
BUCKET_BYTES = X.BUCKET_BYTES


FIRST = 4  # words of the first level at most


def _levels(window: int) -> list[int]:
    """Ascending lengths, each at most twice the one before, from FIRST at most up to the window."""
    out = [window]
    while out[0] > FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _ids(table: pa.Table) -> np.ndarray:
    return table.column(X.DOC).fill_null(LOWEST).to_numpy()


class _Windows:
    """A bucket's windows that may still repeat, level by level, with their sequences at the levels up to `upto`."""

    def __init__(self, table: pa.Table, window: int, upto: int):
        ids, self.levels = _ids(table), _levels(window)
        self.data, self.offsets = column(table.column(X.TEXT))
        self.chunks, at, doc, parts, size = [], [], [], [[] for _ in range(upto + 1)], []
        for i, j in chunks(self.offsets):
            w = Words(self.data, self.offsets, i, j)
            full, ok = w.grams(window)
            here = np.flatnonzero(ok)
            for k, length in enumerate(self.levels[: upto + 1]):
                if length == window:
                    parts[k].append(full[here])
                else:
                    grams, _ = w.grams(length)
                    parts[k].append(grams[minimizers(grams, window - length + 1)[here]] if len(here) else full[:0])
            at.append(here.astype(np.int32))
            doc.append(ids[i + w.doc[here]])
            size.append(len(here))
            self.chunks.append((i, j))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        self.at, self.doc, self.parts = cat(at, np.int32), cat(doc, np.int64), [cat(x, np.uint64) for x in parts]
        self.cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)  # of the chunks

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct sequences of the windows left with the least and the largest document that holds each."""
        k, d = self.parts[level], self.doc
        if self.levels[level] < self.levels[-1] and len(k):  # neighbouring windows mostly share their least part
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            k, d = k[new], d[new]
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        return (k[cuts], np.minimum.reduceat(d, cuts), np.maximum.reduceat(d, cuts)) if len(cuts) else (k, d, d)

    def narrowed(self, answers: list[np.ndarray]) -> _Windows:
        """Without the windows whose sequence at a level doesn't repeat. answers: one bit for each of keys(), for the first levels."""
        for level, repeated in enumerate(answers):
            ok = _among(self.parts[level], self.keys(level)[0][repeated])
            self.at, self.doc = self.at[ok], self.doc[ok]
            self.parts = [x[ok] if k > level else x[:0] for k, x in enumerate(self.parts)]
            self.cuts = np.concatenate([[0], np.cumsum(ok)])[self.cuts]
        return self


def _among(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == values


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Removes each word that a window of `window` words covers whose sequence also starts in a document of smaller doc_id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input. Returns doc_id, n_words, n_removed and
    kept_text (kept words joined by one space), one row for each input row. A null or empty text has no words; texts of
    fewer words than a window stay whole. A null doc_id counts as the smallest. Rows that repeat a doc_id are parts of
    one document and remove nothing from each other. Other columns of docs are ignored. Sequences are equal when
    their 64-bit fingerprints are.
    """
    n = X.buckets_for(docs, BUCKET_BYTES)
    rows = X.bucketed(docs, n)
    owners = n

    last = len(_levels(window)) - 1

    def answers_of(said: pa.Table, upto: int) -> list[np.ndarray]:
        level = said.column("level").to_numpy() if said.num_rows else np.empty(0, np.int32)
        return [X.bits(said.filter(pa.array(level == k))) for k in range(upto)]

    def asked(level: int):
        def ask(table: pa.Table, said: pa.Table | None = None) -> pa.Table:
            if not table.num_rows:
                return X.ASK_SCHEMA.empty_table()
            keys, least, most = _Windows(table, window, level).narrowed(answers_of(said, level) if level else []).keys(level)
            trim()
            return X.asks(table.column(X.BUCKET)[0].as_py(), keys, owners, least if level == last else (least != most).astype(np.uint8))

        return ask if level else lambda table: ask(table)

    def own_parts(table: pa.Table) -> pa.Table:
        keys, cuts, several = X.received(table)
        _, which, count = X.inverse_counts(keys)
        repeated = count > 1
        repeated[which[np.frombuffer(b"".join(several), np.uint8) > 0]] = True
        return X.answers(table, [np.packbits(repeated[which[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])])

    def own_windows(table: pa.Table) -> pa.Table:
        keys, cuts, mins = X.received(table)
        least = np.frombuffer(b"".join(mins), np.int64)
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        overall = np.empty(len(keys), np.int64)
        overall[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(keys))))
        earlier = overall < least
        return X.answers(table, [np.packbits(earlier[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])])

    def remove(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        *parts, earlier = answers_of(said, last + 1)
        live = _Windows(table, window, last).narrowed(parts)
        keys, least, _ = live.keys(last)
        where = np.searchsorted(keys, live.parts[last])
        at, gone, cuts = live.at, (earlier[where] | (least[where] < live.doc) if len(where) else np.empty(0, bool)), live.cuts
        n_words, n_removed, texts = [], [], []
        for (i, j), a, b in zip(live.chunks, cuts[:-1], cuts[1:]):
            w = Words(live.data, live.offsets, i, j)
            marks = np.zeros(len(w) + window + 1, np.int32)
            marks[at[a:b][gone[a:b]]] += 1  # each place once
            covered = np.cumsum(marks)
            covered[window:] -= covered[:-window].copy()
            keep = covered[: len(w)] == 0
            total = np.diff(w.first)
            left = np.bincount(w.doc[keep], minlength=j - i)
            n_words.append(total)
            n_removed.append(total - left)
            texts.append(_joined(w, keep, left))
        out = pa.chunked_array(texts, pa.string()) if texts else pa.chunked_array([], pa.string())
        trim()
        return pa.table([table.column(X.DOC).cast(pa.int64()), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), out], schema=OUT)

    said = None
    for level in range(last + 1):
        sent = rows.groupBy(X.BUCKET)
        sent = (sent if said is None else sent.cogroup(said.groupBy(X.BUCKET))).applyInArrow(asked(level), X.ASK)
        told = X.owned(sent, own_windows if level == last else own_parts).withColumn("level", F.lit(level))
        said = told if said is None else said.unionByName(told)
    return rows.groupBy(X.BUCKET).cogroup(said.groupBy(X.BUCKET)).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def _joined(w: Words, keep: np.ndarray, left: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    start, end = w.start[keep], w.end[keep]
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    source = w.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    ends = np.cumsum(end - start + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = source
    # the space after a text's last word goes
    last = np.cumsum(left)
    upto = np.concatenate([[0], ends])[last]
    some = left > 0
    body[:] = True
    body[upto[some] - 1] = False
    offsets = np.concatenate([[0], upto - np.cumsum(some)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(left), pa.py_buffer(offsets), pa.py_buffer(out[body]))
