"""Op 8. Near copies by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. Rounds 0..t-1 hash every element of a set to a bin and a value; a bin keeps its least
(round, value). Rounds t..2t-1 send every element to bin round - t, so every coordinate is filled and the sketch has
the concentration of independent samples. Sets whose sketch agrees in all coordinates of a band are candidates.
Equal sets are one class before that, so copies cost nothing further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .exact_dedup import attach
from .kernel import MUL, U, Words, chunks, column, mix, trim

BANDS, ROWS = 40, 5
LOWEST = -(2**63)
BLOCK, BLOCK_SHINGLES, SLAB = 64, 400_000, 1 << 13


def shingle_sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted by text: fingerprints of distinct shingles, their cuts) of texts i..j; a text of fewer words is one shingle."""
    w = Words(data, offsets, i, j, lower=True)
    full, ok = w.grams(width)
    at = np.flatnonzero(ok)
    doc, hashes = w.doc[at], full[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.array([int(np.bitwise_xor.reduce(mix(w.hash[a:b] + np.arange(b - a, dtype=U) * U(MUL)))) for a, b in zip(w.first[short], w.first[short + 1])], U)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, mix(whole + count[short].astype(U))])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(j - i + 1))


def sketches(hashes: np.ndarray, cuts: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t numbers for each set; rows of empty sets mean nothing."""
    n = len(cuts) - 1
    sets = np.repeat(np.arange(n), np.diff(cuts))
    out = np.full(n * t, ~U(0))
    live = np.diff(cuts) > 0
    for r in range(2 * t):
        own = live[sets]
        h, s = hashes[own], sets[own]
        x = mix(h + U((r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        bins = ((x >> U(32)) * U(t) >> U(32)).astype(np.int64) if r < t else r - t
        value = (U(r) << U(52)) | (mix(x) >> U(12))
        np.minimum.at(out, s * t + bins, value)
        if r < t:
            live &= (out.reshape(n, t) == ~U(0)).any(axis=1)
        if not live.any():
            break
    return out.reshape(n, t)


CLASS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketch(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = column(batch.column(2))
            for i, j in chunks(offsets):
                h, cuts = shingle_sets(data, offsets, i, j, width)
                size = np.diff(cuts)
                t = bands * rows
                # a band's number: all its coordinates and its place, mixed
                s = sketches(h, cuts, t).reshape(-1, bands, rows)
                code = np.zeros(s.shape[:2], U)
                for r in range(rows):
                    code = mix(code * U(MUL) + s[:, :, r])
                code = mix(code + np.arange(bands, dtype=U) * U(0x632BE59BD9B4E019))
                # one more zero, so that empty texts at the end of a chunk have a place of their own
                both = [np.add.reduceat(np.append(x, U(0)), cuts[:-1]) for x in (mix(h), mix(h ^ U(0xD6E8FEB86659FD93)))]
                both = [np.where(size > 0, x, U(0)).astype(np.int64) for x in both]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size, pa.int64()), pa.array(both[0]), pa.array(both[1]), pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * bands, pa.int32()), pa.array(code.view(np.int64).ravel()))], schema=CLASS)
        trim()

    return run


def _sets(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all texts' sets one after another, their cuts)."""
    data, offsets = column(table.column(X.TEXT))
    parts = [shingle_sets(data, offsets, i, j, width) for i, j in chunks(offsets)]
    cuts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c) for _, c in parts]))]) if parts else np.zeros(1, np.int64)
    return np.concatenate([h for h, _ in parts]) if parts else np.empty(0, U), cuts.astype(np.int64)


def _taken(h: np.ndarray, cuts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets number `which` one after another, and for each element its place in `which`."""
    size = cuts[which + 1] - cuts[which]
    shift = cuts[which] - (np.cumsum(size) - size)
    return h[np.arange(int(size.sum())) + np.repeat(shift, size)], np.repeat(np.arange(len(which)), size)


def alike(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets x of a and y of b, pair by pair, are alike enough."""
    ok = np.zeros(len(x), bool)
    sizes = (np.diff(a[1])[x], np.diff(b[1])[y])
    begin = 0
    for end in _slices(sizes[0] + sizes[1]):
        u, v = x[begin:end], y[begin:end]
        (p, i), (q, j) = _taken(*a, u), _taken(*b, v)
        h, pair = np.concatenate([p, q]), np.concatenate([i, j])
        order = np.lexsort((h, pair))
        h, pair = h[order], pair[order]
        twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
        both = np.bincount(pair[1:][twice], minlength=len(u))
        union = sizes[0][begin:end] + sizes[1][begin:end] - both
        ok[begin:end] = (100 * both >= percent * union) & (union > 0)
        begin = end
    return ok


def _slices(sizes: np.ndarray, limit: int = 1 << 17):
    """Ends of runs whose sizes add up to about limit."""
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        begin = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, "right")))
        yield begin


def _verify(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table, hubs: pa.Table) -> pa.Table:
        if not table.num_rows or not hubs.num_rows:
            return schema.empty_table()
        names = hubs.column("a").to_numpy()
        order = np.argsort(names, kind="stable")
        place = order[np.searchsorted(names[order], table.column("a").to_numpy())]
        ok = pa.array(alike(_sets(hubs, width), _sets(table, width), place, np.arange(table.num_rows), percent))
        trim()
        return pa.table([table.column("a").filter(ok), table.column("b").filter(ok)], schema=schema)

    return run


FAN = 256  # pairs that share one copy of a hub's text


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are alike enough. texts: one text for each id. The text of b travels with its pair, that of a
    once for FAN pairs, so a text that is in very many pairs costs little more than the others."""
    about = texts.agg(F.avg(F.octet_length(X.TEXT))).first()[0] or 0
    groups = max(1, int(pairs.count() * about) >> 22)
    fans = X.cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")))
    spread = attach(pairs, fans, "a", "fan").withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / FAN)))
    spread = X.cut(spread.select("a", "b", "chunk", F.pmod(F.xxhash64("a", "chunk"), F.lit(groups)).alias("g")))
    left = spread.join(texts.select(F.col("id").alias("b"), X.TEXT), "b").select("g", "a", "b", X.TEXT)
    right = spread.select("g", "a").distinct().join(texts.select(F.col("id").alias("a"), X.TEXT), "a").select("g", "a", X.TEXT)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, as cogroup wants
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_verify(width, percent), "a long, b long")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets (sorted distinct fingerprints) are alike enough, as a symmetric matrix; none is its own."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    known, which, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held[which] > 1
    place = (np.cumsum(held > 1) - 1)[which[common]]
    owner = np.repeat(np.arange(len(sets)), size)[common]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, SLAB):
        a, b = np.searchsorted(place, [lo, lo + SLAB])
        part = np.zeros((len(sets), SLAB), np.float32)
        part[owner[a:b], place[a:b] - lo] = 1
        both += (part @ part.T).astype(np.int64)
    union = size[:, None] + size - both
    ok = (100 * both >= percent * union) & (union > 0)
    np.fill_diagonal(ok, False)
    return ok


def _count(width: int, percent: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        data, offsets = column(table.column(X.TEXT))
        sets: list[np.ndarray] = []
        for i, j in chunks(offsets):
            h, cuts = shingle_sets(data, offsets, i, j, width)
            sets += [h[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        c, block = table.column("c").to_numpy(), table.column("block").to_numpy()
        across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        links = np.zeros(len(sets), np.int64)
        order = np.argsort(c, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
            ok = linked([sets[r] for r in own], percent)
            links[own] = (ok & (block[own, None] != block[own]) if across else ok).sum(axis=1)
        return pa.table([table.column("id"), pa.array(links)], schema=schema)

    return run


def count_links(parts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, links) of all classes in parts (id, c, n_shingles) that share their component c: how many others of it each is
    linked to. All pairs of a component are verified on full sets. A component is split into blocks of about BLOCK classes or
    BLOCK_SHINGLES shingles, and every two blocks meet in one group; small components share groups."""
    room = parts.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("w")).where("m > 1")
    room = X.cut(room.withColumn("blocks", F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("w") / F.lit(BLOCK_SHINGLES))).cast("int")))
    groups = max(1, -(-(room.where("blocks = 1").agg(F.sum("w")).first()[0] or 0) // BLOCK_SHINGLES))
    placed = attach(parts.select("id", "c"), room.select("c", "m", "blocks"), "c", "m").where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    end = lambda f: F.when(alone, F.lit(-1)).otherwise(f("block", "other"))
    cells = cells.select("id", "c", "block", F.when(alone, F.pmod(F.xxhash64("c"), F.lit(groups))).otherwise(F.col("c")).alias("g"), end(F.least).alias("x"), end(F.greatest).alias("y"))
    return cells.join(texts, "id").groupBy("g", "x", "y").applyInArrow(_count(width, percent), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def components(links: DataFrame, hot: int | None = None) -> DataFrame:
    """(id, c) of every id in links (a, b): c is the least id that can be reached. Alternates between each vertex taking
    the least label around it and labels taking their own label, so that chains halve; every round is kept in the shared folder.
    Labels that more than `hot` rows (attach's HOT_ROWS) ask for are few and broadcast, so neither a hub's links nor a large component meet in one task."""
    edges = X.cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = X.cut(edges.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("c"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "id"))
    last = label
    while True:
        near = attach(edges, label.select(F.col("id").alias("b"), "c", "n"), "b", "n", hot).groupBy("a").agg(F.min("c").alias("m"))
        step = X.cut(label.join(near.withColumnRenamed("a", "id"), "id").select("id", "n", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        asked = step.groupBy("c").agg(F.count(F.lit(1)).alias("many"))
        up = X.cut(asked.join(step.select(F.col("id").alias("c"), F.col("c").alias("top")), "c"))
        new = X.cut(attach(step, up, "c", "many", hot).select("id", "n", "old", F.least(F.col("c"), F.coalesce("top", "c")).alias("c")))
        for x in (last, step, up):
            X.release(x)
        if new.where("c <> old").isEmpty():
            X.release(edges)
            return new.select("id", "c")
        last, label = new, new.select("id", "c", "n")


PAIRS = 16  # classes that a bucket may have for all its pairs to be listed
HUBS = 2  # further hubs that a larger bucket has before its blocks are set against each other


def _across(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """Links between different components within one block or between two, as many as join them: fewer than there are classes."""
        ids, c, block = (table.column(x).to_numpy() for x in ("id", "c", "block"))
        h, cuts = _sets(table, width)
        ok = linked([h[x:y] for x, y in zip(cuts[:-1], cuts[1:])], percent)
        ok &= c[:, None] != c
        if table.column("x")[0].as_py() != table.column("y")[0].as_py():
            ok &= block[:, None] != block
        root = {int(v): int(v) for v in c}

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        out = []
        for i, j in zip(*np.nonzero(np.triu(ok))):
            p, q = top(int(c[i])), top(int(c[j]))
            if p != q:
                root[p] = q
                out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)

    return run


def merged(inner: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(id, c) of all classes that are linked to another one, from inner (key, id, s, n, hub): the buckets' members with their set's size, their
    number and their least member. None if there are no links.

    Every member is set against its bucket's hub first. A bucket whose members are then still in several components goes
    on: one of up to PAIRS classes lists its pairs; a larger one gets HUBS further hubs, and what is left of it is cut into
    blocks of BLOCK classes, every two of which meet in one task. So no pair of a bucket is left out whose classes aren't joined
    already, and no more pairs are listed than PAIRS times as many as the buckets have members.
    """
    tested = X.cut(inner.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    links = X.cut(confirmed(tested, texts, width, percent))
    sizes = f"100 * least(x.s, y.s) >= {percent} * greatest(x.s, y.s)"

    def parted() -> DataFrame:
        """The members of buckets that have several components."""
        one = inner.select("key", "id", "s", "n")
        rows = one.join(found, "id", "left").withColumn("c", F.coalesce("c", "id")) if found is not None else one.withColumn("c", F.col("id"))
        rows = X.cut(rows)
        several = X.cut(rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"))
        return X.cut(attach(rows.drop("n"), several, "key", "n").where("lo is not null").drop("lo", "hi"))

    def joined(more: DataFrame):
        new = X.cut(more)
        if new.isEmpty():
            return links, found
        both = X.cut(links.unionByName(new))
        return both, components(both)

    found = None if links.isEmpty() else components(links)
    rest = parted()
    small, large = rest.where(f"n <= {PAIRS}"), rest.where(f"n > {PAIRS}")
    for turn in range(HUBS):
        if large.isEmpty():
            break
        hubs = X.cut(large.groupBy("key").agg(F.min_by(F.struct("id", "c", "s"), F.xxhash64("id", F.lit(turn))).alias("y"), F.count(F.lit(1)).alias("m")))
        pairs = attach(large.select("key", F.struct("id", "c", "s").alias("x")), hubs, "key", "m").where(f"x.c <> y.c and {sizes}")
        pairs = X.cut(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        tested = X.cut(tested.unionByName(pairs))
        links, found = joined(confirmed(pairs, texts, width, percent))
        rest = parted()
        small, large = rest.where(f"n <= {PAIRS}"), rest.where(f"n > {PAIRS}")
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.expr(f"x.key = y.key and x.c < y.c and {sizes}")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    pairs = X.cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
    late = confirmed(pairs, texts, width, percent)
    if not large.isEmpty():
        cells = large.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("id", "c", "block", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).join(texts, "id")
        late = late.unionByName(cells.groupBy("key", "x", "y").applyInArrow(_across(width, percent), "a long, b long"))
    return joined(late)[1]


def near_groups(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, with_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and, with_links, links of every row.

    A text's set has its distinct sequences of `width` words, A-Z lower-cased; a text of fewer words is one sequence, and
    a null or empty one, or one without words, has no set and no links. Texts are linked when
    100 * |intersection| >= percent * |union|, confirmed on full sets of 64-bit fingerprints. component_id is the
    smallest doc_id that can be reached; class_id the smallest with the same set; links the number of other
    classes (different sets) that this row's class is linked to, all pairs of a component being verified. Every candidate pair
    is confirmed or joins one component anyway: no bucket is capped. With 40 bands of 5 coordinates a pair exactly at the threshold is missed with probability 1.2e-7. A null
    doc_id counts as the smallest. Rows that repeat a doc_id or a text are rows of one class. Other columns are ignored.
    """
    slim, of = _grouped(docs, width, percent, bands, rows, with_links)
    more = ["links"] if with_links else []
    out = attach(slim.select(X.DOC, "n_shingles", "id"), of.select("id", "members", "class_id", "component_id", *more), "id", "members")
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(
        back(X.DOC).alias(X.DOC), "n_shingles",
        F.when(F.col("members").isNull(), back(X.DOC)).otherwise(back("component_id")).alias("component_id"),
        F.when(F.col("members").isNull(), back(X.DOC)).otherwise(back("class_id")).alias("class_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in more],
    )


def _grouped(docs: DataFrame, width: int, percent: int, bands: int, rows: int, with_links: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles and class id of every row; of every class its id, members, class_id, the component's least row (doc_id and th),
    and links). th: a hash of the text."""
    base = X.corpus(docs).select(F.coalesce(X.DOC, F.lit(LOWEST)).alias(X.DOC), F.xxhash64(F.coalesce(X.TEXT, F.lit(""))).alias("th"), X.TEXT)
    slim = X.cut(base.mapInArrow(_sketch(width, bands, rows), "doc_id long, th long, n_shingles long, d1 long, d2 long, bands array<long>"))
    some = slim.where("n_shingles > 0").withColumn("id", F.xxhash64("d1", "d2", "n_shingles"))
    # classes of equal sets; equal sets have equal bands, so any will do
    classes = some.groupBy("id", "n_shingles").agg(F.min(F.struct(X.DOC, "th")).alias("least"), F.count(F.lit(1)).alias("members"), F.first("bands").alias("bands"))
    classes = X.cut(classes.select("id", "n_shingles", "least.*", "members", "bands"))
    entry = classes.select("id", F.col("n_shingles").alias("s"), F.explode("bands").alias("key"))
    counted = X.cut(entry.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    inner = X.cut(attach(entry, counted, "key", "n").where("hub is not null"))
    # one text for each class that has a candidate; the others stay where they are
    chosen = X.cut(classes.join(inner.select("id").distinct(), "id").select("id", X.DOC, "th", F.xxhash64(X.DOC, "th").alias("h")))
    texts = base.where(X.sieve(chosen, "h")(F.xxhash64(X.DOC, "th"))).join(chosen.drop("h"), [X.DOC, "th"])
    texts = X.cut(texts.groupBy("id").agg(F.first(F.coalesce(X.TEXT, F.lit(""))).alias(X.TEXT)))
    found = merged(inner, texts, width, percent)
    of = classes.select("id", "n_shingles", F.col(X.DOC).alias("class_id"), "th", "members")
    of = of.join(found, "id", "left").withColumn("c", F.coalesce("c", "id")) if found is not None else of.withColumn("c", F.col("id"))
    of = X.cut(of)
    more = []
    if with_links:
        degree = X.cut(count_links(of.select("id", "c", "n_shingles"), texts, width, percent))
        of = X.cut(of.join(degree, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long")))
        more = ["links"]
    whole = of.groupBy("c").agg(F.min(F.struct(F.col("class_id").alias("component_id"), F.col("th").alias("component_th"))).alias("first"), F.count(F.lit(1)).alias("parts"))
    of = X.cut(attach(of, whole.select("c", "parts", "first.*"), "c", "parts").select("id", "members", "class_id", "component_id", "component_th", *more))
    return slim.select(X.DOC, "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.xxhash64("d1", "d2", "n_shingles")).alias("id")), of


def near_dedup(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, of which one stays in each component: that with the smallest doc_id, and of several such the one with the least hash
    of its text. Rows without words stay. Rows that repeat a doc_id are told apart by their texts; of rows that repeat both, one stays."""
    slim, of = _grouped(docs, width, percent, bands, rows, False)
    marks = attach(slim, of, "id", "members").where("members is not null")
    first = (F.col(X.DOC) == F.col("component_id")) & (F.col("th") == F.col("component_th"))
    marks = X.cut(marks.select(F.col(X.DOC).alias("_d"), F.col("th").alias("_t"), first.alias("_first")))
    key = F.coalesce(F.col(X.DOC).cast("long"), F.lit(LOWEST))
    text = F.xxhash64(F.coalesce(F.col(X.TEXT).cast("string"), F.lit("")))
    match = (F.col("_d") == key) & (F.col("_t") == text)
    gone = marks.where("not _first").select("_d", "_t").distinct().withColumn("_h", F.xxhash64("_d", "_t"))
    out = X.left_out(docs, X.cut(gone), F.xxhash64(key, text), match, "_h")
    again = X.cut(marks.where("_first").groupBy("_d", "_t").count().where("count > 1").select("_d", "_t"))
    if again.isEmpty():
        return out
    return out.join(again, match, "left_anti").unionByName(out.join(again, match, "left_semi").dropDuplicates([X.DOC, X.TEXT]))
