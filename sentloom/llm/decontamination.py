"""Op 1. Benchmark decontamination by BM25 with block-max WAND.

Test items are in an inverted index with impacts in blocks; every passage of every text is a query. An item's impacts are divided by
the score it gives itself, so one threshold serves all. Bounds are tested for all passages at once: what an item's common
terms can add is known from the index, and the rest must come from its rare terms. Passages where that suffices
for some item go through block-max WAND. What that retrieves is verified by the overlap of word n-grams with the
item's question and with its answer.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import PUNCT, Words, chunks, column

INDEX_BYTES = 8 << 20  # texts of test items in one index; more items make more indexes, one after another
BLOCK = 32
COMMON = 0.5  # share of the threshold that an item's common terms may reach together


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last line, else its last sentence, else the last quarter of its words is the answer."""
    text = text.strip()
    for pattern in (r"\n+", r"(?<=[.!?])\s+"):
        parts = re.split(pattern, text)
        if len(parts) > 1:
            return text[: len(text) - len(parts[-1])], parts[-1]
    words = text.split()
    k = max(1, len(words) // 4)
    return " ".join(words[:-k]), " ".join(words[-k:])


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = column(pa.array(texts, pa.large_string()))
    if not len(texts):
        return []
    w = Words(data, offsets, 0, len(texts), lower=True, space=PUNCT)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def ngrams(words: np.ndarray, n: int) -> set[tuple]:
    words = words.tolist()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


@dataclass
class Index:
    """Postings of each term: items in ascending order, their impacts, and each block's last item and largest impact."""

    terms: np.ndarray  # sorted fingerprints
    bound: np.ndarray  # the largest impact of each term
    postings: list[tuple[list[int], list[float], list[int], list[float]]]
    ids: list[int]
    parts: list[tuple[set, int, set, int]]  # question n-grams and n, answer n-grams and n
    longest: int
    rare: np.ndarray  # of each term, whether it is rare
    common: np.ndarray  # of each item, the most that its other terms add to a score
    at: np.ndarray  # cuts of the flat postings below
    items: np.ndarray
    impacts: np.ndarray

    @staticmethod
    def build(ids: list[int], texts: list[str], threshold: float, k1: float = 1.2, b: float = 0.75) -> Index:
        words = _hashes(texts)
        counts = [np.unique(w, return_counts=True) for w in words]
        size = np.array([len(w) for w in words], float)
        mean = max(1.0, size.mean()) if len(size) else 1.0
        df: dict[int, int] = {}
        for t, _ in counts:
            for x in t.tolist():
                df[x] = df.get(x, 0) + 1
        lists: dict[int, list[tuple[int, float]]] = {}
        for d, (t, c) in enumerate(counts):
            idf = np.array([np.log(1 + (len(ids) - df[x] + 0.5) / (df[x] + 0.5)) for x in t.tolist()])
            impact = idf * c * (k1 + 1) / (c + k1 * (1 - b + b * size[d] / mean))
            own = impact.sum() or 1.0
            for x, i in zip(t.tolist(), (impact / own).tolist()):
                lists.setdefault(x, []).append((d, i))
        terms = np.array(sorted(lists), np.uint64)
        postings = []
        for x in terms.tolist():
            docs, imp = [d for d, _ in lists[x]], [i for _, i in lists[x]]
            at = range(0, len(docs), BLOCK)
            postings.append((docs, imp, [docs[min(a + BLOCK, len(docs)) - 1] for a in at], [max(imp[a : a + BLOCK]) for a in at]))
        parts = []
        for pair in (_hashes(list(question_and_answer(t))) for t in texts):
            q, a = pair
            nq, na = min(3, max(1, len(q))), min(3, max(1, len(a)))
            parts.append((ngrams(q, nq), nq, ngrams(a, na), na))
        bound = np.array([max(p[1]) for p in postings])
        at = np.concatenate([[0], np.cumsum([len(p[0]) for p in postings])]).astype(np.int64)
        items = np.array([d for p in postings for d in p[0]], np.int64)
        impacts = np.array([i for p in postings for i in p[1]])
        rare, common = np.ones(len(terms), bool), np.zeros(len(ids))
        for t in np.argsort(-np.diff(at), kind="stable").tolist():  # the most frequent first
            of = items[at[t] : at[t + 1]]
            more = common[of] + impacts[at[t] : at[t + 1]]
            if (more <= COMMON * threshold).all():  # so that no passage reaches the threshold by common terms alone
                common[of] = more
                rare[t] = False
        return Index(terms, bound, postings, ids, parts, int(size.max(initial=1)), rare, common, at, items, impacts)

    def possible(self, place: np.ndarray, rare: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float) -> np.ndarray:
        """Passages of which an item may reach the threshold: its rare terms there, and all its common ones."""
        where = np.flatnonzero(rare)
        lo, hi = np.searchsorted(where, begin), np.searchsorted(where, end)
        size = hi - lo
        token = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(np.arange(len(begin)), size) * len(self.terms) + place[where[token]])
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        size = self.at[term + 1] - self.at[term]
        flat = np.repeat(self.at[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        code, which = np.unique(np.repeat(passage, size) * len(self.ids) + self.items[flat], return_inverse=True)
        total = np.bincount(which, weights=self.impacts[flat], minlength=len(code))
        live = total + self.common[code % len(self.ids)] >= threshold - 1e-9
        return np.unique(code[live] // len(self.ids))

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of at least threshold for distinct terms `query`, by block-max WAND."""
        lists = [[0, *self.postings[t], float(self.bound[t])] for t in query]  # place, items, impacts, block ends, block maxima, bound
        out = []
        slack = threshold - 1e-9
        while True:
            lists = [x for x in lists if x[0] < len(x[1])]
            lists.sort(key=lambda x: x[1][x[0]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[5]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            head = lists[: pivot + 1]
            blocks = [bisect.bisect_left(x[3], item) for x in head]
            if sum(x[4][b] for x, b in zip(head, blocks) if b < len(x[4])) < slack:
                # no item up to the nearest block end can reach the threshold
                steps = [x[3][b] + 1 for x, b in zip(head, blocks) if b < len(x[3])]
                if pivot + 1 < len(lists):
                    steps.append(lists[pivot + 1][1][lists[pivot + 1][0]])
                step = max(min(steps), item + 1)
                for x in head:
                    x[0] = bisect.bisect_left(x[1], step, x[0])
            elif head[0][1][head[0][0]] == item:
                score = sum(x[2][x[0]] for x in head)
                if score >= slack:
                    out.append((item, score))
                for x in head:
                    x[0] += 1
            else:
                for x in head:
                    if x[1][x[0]] < item:
                        x[0] = bisect.bisect_left(x[1], item, x[0])

    def hits(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of all verified matches in texts i..j, best of the text's passages."""
        w = Words(data, offsets, i, j, lower=True, space=PUNCT)
        if not len(w) or not len(self.terms):
            return []
        place = np.searchsorted(self.terms, w.hash)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == w.hash
        stride = max(64, self.longest)
        count = np.diff(w.first)
        per = np.maximum(1, -(-count // stride) - 1) * (count > 0)  # any `longest` words in a row are within one passage
        text = np.repeat(np.arange(j - i), per)
        begin = w.first[:-1][text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
        end = np.minimum(begin + 2 * stride, w.first[1:][text])
        live = self.possible(place, known & self.rare[place], begin, end, threshold)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p in live.tolist():
            a, b = int(begin[p]), int(end[p])
            query = np.unique(place[a:b][known[a:b]])
            if self.bound[query].sum() < threshold - 1e-9:
                continue
            found = self.search(query.tolist(), threshold)
            grams: dict[int, set] = {}
            for item, score in found:
                q, nq, r, nr = self.parts[item]
                for n in (nq, nr):
                    if n not in grams:
                        grams[n] = ngrams(w.hash[a:b], n)
                of_q = len(q & grams[nq]) / len(q) if q else 1.0
                of_a = len(r & grams[nr]) / len(r) if r else 1.0
                if of_q >= overlap and of_a >= overlap:
                    key = (i + int(text[p]), item)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, of_q, of_a))
        return [(t, self.ids[item], *x) for (t, item), x in sorted(best.items())]


def indexes(benchmark: DataFrame, threshold: float):
    """Indexes of all items for one threshold, each of a bounded size: items are dealt to as many as their bytes need. Null or empty items match nothing."""
    if not threshold > 0:
        raise ValueError("a threshold of 0 would match items that share no word with a text")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // INDEX_BYTES))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if got.num_rows:
            yield Index.build(got.column(0).to_pylist(), got.column(1).to_pylist(), threshold)


THRESHOLD, OVERLAP = 0.6, 0.6
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
FOUND_SQL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every text and test item that it holds.

    A text is cut into overlapping passages so that any run of words as long as the longest item lies in one. An item is retrieved
    if the passage's BM25 score is at least threshold times the score the item gives itself, and verified if the
    passage holds at least `overlap` of the word trigrams of the item's question, and of its answer. Words are lower-cased runs
    of letters and digits. Null or empty texts and items match nothing; rows that repeat a doc_id give a row
    each for each item, and so do repeated items. Other columns are ignored. Nothing is shuffled.
    """
    out = None
    for index in indexes(benchmark, threshold):
        one = _search(docs, index, threshold, overlap)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], FOUND_SQL) if out is None else out


def _search(docs: DataFrame, index: Index, threshold: float, overlap: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            data, offsets = column(batch.column(1))
            ids = batch.column(0)
            for i, j in chunks(offsets):
                hits = shared.value.hits(data, offsets, i, j, threshold, overlap)
                if hits:
                    cols = list(zip(*hits))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *[pa.array(c, f.type) for c, f in zip(cols[1:], list(FOUND)[1:])]], schema=FOUND)

    return X.corpus(docs).mapInArrow(run, FOUND_SQL)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, all columns, that hold no test item; see contamination()."""
    for index in indexes(benchmark, threshold):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap)(F.col(X.TEXT).cast("string")))
    return docs


def _clean(shared, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        data, offsets = column(pa.array(text, pa.string(), from_pandas=True))
        out = np.ones(len(text), bool)
        for i, j in chunks(offsets):
            for hit in shared.value.hits(data, offsets, i, j, threshold, overlap):
                out[hit[0]] = False
        return pd.Series(out)

    return clean
