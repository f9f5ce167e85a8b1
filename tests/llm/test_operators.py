import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentloom.llm import decontamination, exact_dedup, kernel, language_model, line_dedup, near_dedup, packing, quality, sharding, substring_dedup, suffix_dedup


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plain(rows):
    return sorted(rows, key=repr)


def sha(c):
    return F.sha2(c, 256)


# ---- kernels --------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.integers(1, 20), st.data())
def test_suffix_array(text, depth, data):
    raw = text.encode()
    t = np.frombuffer(raw, np.uint8)
    assert suffix_dedup.two_stage(t).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    need = np.array(data.draw(st.lists(st.booleans(), min_size=len(raw), max_size=len(raw))), bool)
    order = suffix_dedup.two_stage(t, need, depth)
    assert sorted(order.tolist()) == np.flatnonzero(need).tolist()
    assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in order)
    lcp = suffix_dedup.adjacent_prefixes(t, order, depth)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:depth], raw[order[k] :][:depth]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.integers(0, 60))
def test_golomb(values, shift):
    x = np.unique(np.array(sorted(values), np.uint64) >> np.uint64(shift))
    r, unary, rest = kernel.rice_encode(x - (x[0] if len(x) else 0))
    back = kernel.rice_decode(len(x), r, unary, rest)
    assert (back == x - (x[0] if len(x) else np.uint64(0))).all() and len(back) == len(x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=50), st.integers(1, 9))
def test_minimizers(xs, width):
    h = kernel.mix(np.array(xs, np.uint64))
    exp = [i + int(np.argmin(h[i : i + width])) for i in range(len(xs) - width + 1)]
    got = kernel.minimizers(h, width)
    assert [h[i] for i in got] == [h[i] for i in exp] and got.tolist() == exp


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB é \n\t\x0b", max_size=20), min_size=1, max_size=8))
def test_words(texts):
    import pyarrow as pa

    data, offsets = kernel.column(pa.array(texts))
    w = kernel.Words(data, offsets, 0, len(texts))
    assert np.diff(w.first).tolist() == [len(brute.WORD.findall(t)) for t in texts]
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in brute.WORD.findall(t)]


# ---- 1: decontamination ---------------------------------------------------------------------------------------------

ITEMS = [(1, "Which river runs through the old town of Brenz? The river Ael runs there, past nine mills."), (2, "How many mills stand there?\nNine."), (3, None), (4, ""), (5, "Which river runs through the old town of Brenz? The river Ael runs there, past nine mills."), (6, "word")]


def test_decontamination(spark, docs, rows, empty):
    bench = spark.createDataFrame([(t, i, "x") for i, t in ITEMS], "text string, item_id long, doc_id string")
    noise = "some words before it and more of them " * 30
    planted = [(1000, noise + ITEMS[0][1].upper() + " " + noise), (1001, ITEMS[0][1][:45]), (1002, noise + " how many mills stand there? NINE! " + noise), (1003, "Which river runs through the old town of Brenz? Nobody knows."), (1004, None), (1000, noise)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = decontamination.contamination(both, bench)
    assert values(got, "doc_id", "item_id") == [(1000, 1), (1000, 5), (1002, 2)]
    clean = decontamination.decontaminate(both.withColumn("lang", F.lit("x")), bench)
    assert clean.columns == ["doc_id", "text", "lang"]
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in rows) + Counter([1000, 1001, 1003, 1004])
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(both, bench.where("false")).count() == 0
    assert decontamination.decontaminate(both, bench.where("false")).count() == both.count()


def test_several_indexes(spark, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    docs = spark.createDataFrame([(0, "well: " + ITEMS[0][1]), (1, ITEMS[1][1])], "doc_id long, text string")
    one = values(decontamination.contamination(docs, bench), "doc_id", "item_id")
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 60)
    assert values(decontamination.contamination(docs, bench), "doc_id", "item_id") == one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=12), min_size=1, max_size=90), st.lists(st.integers(0, 14), min_size=1, max_size=30), st.sampled_from([0.31, 0.45, 0.6, 0.9]))
def test_block_max_wand(items, passage, threshold):
    """The same items and scores as scoring everything."""
    texts = [" ".join(f"w{x}" for x in it) for it in items]
    index = decontamination.Index.build(list(range(len(texts))), texts, 0.31)
    query = " ".join(f"w{x}" for x in passage)
    hashes = np.unique(decontamination._hashes([query])[0])
    known = np.flatnonzero(np.isin(index.terms, hashes))
    score = defaultdict(float)
    for t in known:
        for d, imp in zip(index.postings[t][0], index.postings[t][1]):
            score[d] += imp
    exp = {d: round(s, 9) for d, s in score.items() if s >= threshold - 1e-9}
    assert {d: round(s, 9) for d, s in index.search(known.tolist(), threshold)} == exp
    import pyarrow as pa

    data, offsets = kernel.column(pa.array([query]))
    assert {h[1] for h in index.hits(data, offsets, 0, 1, threshold, 0.0)} == set(exp)


@pytest.mark.parametrize("threshold,overlap", [(0.6, 0.6), (0.3, 0.2), (0.05, 0.0)])
def test_contamination_is_that_of_plain_scoring(spark, rows, threshold, overlap):
    """The whole query against scoring every passage by every item, items of shared and of rare words."""
    import random

    rnd = random.Random(11)
    pool = sorted({w for _, t in rows for w in (t or "").split()})
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(2, 25))) + (".\nYes it is" if i % 2 else "")) for i in range(12)]
    words = next(t for d, t in rows if d == 101).split()
    items += [(20 + i, " ".join(words[at : at + 30])) for i, at in enumerate((0, 700, 5950))] + [(30, None), (31, ""), (32, "?!"), (33, items[0][1])]
    some = [r for r in rows if r[0] is None or r[0] < 60 or r[0] > 95] + [(500 + i, f"{rows[i][1]} {t} {rows[i + 1][1]}") for i, (_, t) in enumerate(items) if t]
    got = decontamination.contamination(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold, overlap)
    exp = brute.contaminated(some, items, decontamination.question_and_answer, threshold, overlap)
    assert len(exp) > 15
    assert values(got, "doc_id", "item_id", *(F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap"))) == plain(exp)
    with pytest.raises(ValueError):
        decontamination.contamination(got, got, 0.0)


# ---- 2: suffix arrays -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width,hot", [(400, 4096), (60, 4096), (60, 3)])
def test_suffix_dedup(docs, rows, monkeypatch, width, hot):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 14)
    out = suffix_dedup.suffix_dedup(docs, width, hot)
    got = values(out, "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long"), (F.size("spans") / 2).cast("long"), sha("kept"))
    assert got == plain(brute.suffix(rows, width))


def test_suffix_spans(docs, rows):
    for r in suffix_dedup.suffix_dedup(docs, 60).collect():
        runs = list(zip(r["spans"][::2], r["spans"][1::2]))
        assert sum(b - a for a, b in runs) == r["n_bytes"] - len(r["kept"]) and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_suffix_regions_of_permuted_rows():
    """Answers come back in the order of regions(), which another task numbers from the same rows in another order."""
    import pyarrow as pa

    core = "the same core of some eighty bytes, which every text below holds in other surroundings, "
    texts = [f"{a} {core}{b}" for a in ("one", "two", "three", "four") for b in ("five", "six", "seven")]
    one, two = (suffix_dedup._Bucket(pa.table({"text": pa.array(x)}), 60) for x in (texts, texts[5:] + texts[:5][::-1]))
    assert (one.keys == two.keys).all()
    a, b = (x.regions(np.ones(len(x.keys), np.uint8)) for x in (one, two))
    assert a[2] == b[2] and (a[3] == b[3]).all() and (a[4] == b[4]).all() and len(set(a[3].tolist())) < len(a[3])
    for x, r in ((one, a), (two, b)):
        assert all(x.data[x.lo[s] : x.hi[s] + 60].tobytes() == r[2][k] for s, k in zip(r[0], r[1]))


# ---- 3: packing -----------------------------------------------------------------------------------------------------

P = __import__("public_tokenizers")


def test_tokens(rows):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Tokens(P.path("byte_bpe_50k.json"), remember=200)
    texts = [t or "" for _, t in rows]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t\x85é1!\x00²ſ日'st<|>", max_size=25), min_size=1, max_size=5))
def test_tokens_property(texts):
    own = packing.tokens_of(P.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins(lengths):
    bins = packing.best_fit(lengths, 40)
    before = sorted(sum(lengths[x] for x in b) ** 2 for b in bins)
    out = packing.local_search([list(b) for b in bins], lengths, 40)
    assert sorted(x for b in out for x in b) == list(range(len(lengths)))
    assert all(sum(lengths[x] for x in b) <= 40 for b in out) and len(out) <= len(bins)
    assert sum(sum(lengths[x] for x in b) ** 2 for b in out) >= sum(before)


def test_local_search_beats_best_fit():
    lengths = [4, 4, 4, 3, 3, 3, 3, 3, 3]  # of 10: best fit takes two fours first
    found = packing.local_search([[0, 1], [2, 3, 4], [5, 6, 7], [8]], lengths, 10)
    assert len(found) == 3


@pytest.mark.parametrize("group", [1 << 16, 16])
def test_packing(docs, rows, empty, monkeypatch, group):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP", group)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 128)
    got = out.collect()
    exp = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        begin, stop, k = 0, (len(ids) - 1) % 128 + 1, 0
        while begin < len(ids):
            exp.append((d, k, begin, stop - begin, zlib.crc32(np.array(ids[begin:stop], "<u4").tobytes())))
            begin, stop, k = stop, stop + 128, k + 1
    assert values(out, "doc_id", "piece", "start", "length", "ids_crc32") == plain(exp)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 128
    least = math.ceil(sum(x[3] for x in exp) / 128)
    assert len(bins) <= (len(packing.best_fit([x[3] for x in exp], 128)) if group > 100 else least + 12)
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json"), 128).count() == 0


# ---- 4 and 5: lines and substrings ----------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [100_000, 2])
def test_lines(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    out = line_dedup.line_dedup(docs)
    assert values(out, "doc_id", "n_lines", "n_dropped", sha("kept_text")) == plain(brute.lines(rows))
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("window", [13, 5, 1])
def test_substrings(docs, rows, empty, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 14)
    out = substring_dedup.substring_dedup(docs, window)
    assert values(out, "doc_id", "n_words", "n_removed", sha("kept_text")) == plain(brute.substring(rows, window))
    assert substring_dedup.substring_dedup(empty, window).count() == 0 and suffix_dedup.suffix_dedup(empty).count() == 0


# ---- 6 and 8: copies and near copies --------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [100_000, 3])
def test_exact(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    out = exact_dedup.exact_groups(docs)
    assert values(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain(brute.exact(rows))
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert values(kept, "doc_id", F.coalesce("text", F.lit(""))) == plain({(x[0], t or "") for x, (_, t) in zip(brute.exact(rows), rows) if x[3]})
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [100_000, 3])
def test_near(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    out = near_dedup.near_groups(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    exp = brute.near(rows)
    assert values(out, "doc_id", "n_shingles", "component_id", kept) == plain(exp)
    assert max(Counter(x[2] for x in exp).values()) > 8
    left = near_dedup.near_dedup(docs)
    assert left.columns == docs.columns
    stays = left.select("doc_id", F.coalesce("text", F.lit(""))).collect()
    sets, root = brute.near_roots(rows)
    assert sum(not brute.shingles(t) for _, t in stays) == sum(not s for s in sets)
    home = {(d, t or ""): r for (d, t), s, r in zip(rows, sets, root) if s}
    least = {r: x[2] for r, x in zip(root, exp)}
    # one row of each component, of its smallest doc_id
    assert Counter(home[tuple(x)] for x in stays if tuple(x) in home) == Counter(set(home.values()))
    assert all(least[home[tuple(x)]] == x[0] for x in stays if tuple(x) in home)
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_near_tells_rows_of_one_doc_id_apart(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "what has nothing to do with any other of these texts"
    left = near_dedup.near_dedup(spark.createDataFrame([(1, a), (1, b), (1, b), (0, a.upper()), (2, a + " thirteen")], "doc_id long, text string"))
    assert values(left, "doc_id", "text") == plain([(0, a.upper()), (1, b)])


@pytest.mark.parametrize("pairs,hubs,block", [(16, 2, 64), (4, 1, 7), (2, 0, 5)])
def test_near_in_groups_just_below_the_threshold(spark, monkeypatch, pairs, hubs, block):
    """Many different texts in the same buckets, of which few are linked: all links count, and pairs aren't all listed."""
    import random

    for name, value in (("PAIRS", pairs), ("HUBS", hubs), ("BLOCK", block)):
        monkeypatch.setattr(near_dedup, name, value)
    listed = []
    real = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda p, *more: (listed.append(p.count()), real(p, *more))[1])
    rnd = random.Random(8)
    first, every = [f"w{i}" for i in range(400)], []
    for i in range(90):
        words = list(first)
        for at in rnd.sample(range(400), rnd.randint(9, 20)):
            words[at] = f"x{rnd.randrange(9)}"
        every.append((i, " ".join(words)))
    exp = brute.near(every)
    groups = {x[2] for x in exp}
    assert 10 < len(groups) < 89
    got = near_dedup.near_groups(spark.createDataFrame(every, "doc_id long, text string"), with_links=False)
    assert values(got, "doc_id", "n_shingles", "component_id", F.col("doc_id") == F.col("component_id")) == plain(exp)
    if pairs < 16:
        assert sum(listed) < 90 * 89 / 4


@pytest.mark.parametrize("block", [64, 7])
def test_near_links(spark, rows, monkeypatch, block):
    """Every link between different sets, in a group whose members meet in few bands and in one that is split into blocks."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(5)
    first = [f"w{i}" for i in range(160)]
    copies = []
    for i in range(40):
        words = list(first)
        for at in rnd.sample(range(160), rnd.randint(1, 12)):
            words[at] = f"x{rnd.randrange(1000)}"
        copies.append((3000 + i, " ".join(words)))
    every = list(rows) + copies + copies[:3]
    sets = [frozenset(brute.shingles(t)) for _, t in every]
    kinds = [s for s in set(sets) if s]
    count = {s: sum(1 for o in kinds if o != s and 100 * len(s & o) >= 80 * len(s | o)) for s in kinds}
    got = near_dedup.near_groups(spark.createDataFrame(every, "doc_id long, text string"))
    assert values(got, "doc_id", "n_shingles", "links") == plain((d, len(s), count.get(s, 0)) for (d, _), s in zip(every, sets))
    assert 5 < max(count.values()) and len(set(count.values())) > 5


def test_digests_before_empty_texts():
    """A set has the same digests wherever its text stands in a chunk."""
    import pyarrow as pa

    def digests(*texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "th", "text"])
        out = pa.Table.from_batches(near_dedup._sketch(2, 4, 1)([batch]))
        return list(zip(out["n_shingles"].to_pylist(), out["d1"].to_pylist(), out["d2"].to_pylist()))

    alone, other = digests("a b c d e")[0], digests("a b c d x")[0]
    assert alone != other and digests("", " ") == [(0, 0, 0)] * 2
    assert digests("a b c d e", "", "\n", "") == [alone] + [(0, 0, 0)] * 3
    assert digests("", "a b c d e", "", "a b c d x", "") == [(0, 0, 0), alone, (0, 0, 0), other, (0, 0, 0)]


def test_sketch_is_unbiased():
    rng = np.random.default_rng(0)
    common, a, b = (kernel.mix(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (80, 10, 10))
    h = [np.sort(np.concatenate([common, x])) for x in (a, b)]
    s = near_dedup.sketches(np.concatenate(h), np.array([0, 90, 180]), 512)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.07
    one = near_dedup.sketches(h[0][:1], np.array([0, 1]), 64)
    assert (one != ~np.uint64(0)).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
    exp = plain([(i, 0) for i in range(31)] + [(50, 50), (70, 50), (100, 50)])
    assert values(got, "id", "c") == exp
    assert values(near_dedup.components(spark.createDataFrame(links, "a long, b long"), hot=1), "id", "c") == exp


# ---- 7: quality -----------------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    import random

    from conftest import prose

    rnd = random.Random(2)
    good = [(i, prose(rnd, rnd.randint(20, 80)), 1) for i in range(2000, 2300)]
    bad = [(i, prose(rnd, rnd.randint(20, 60)).upper().replace(" ", "!! "), 0) for i in range(2300, 2360)]
    table = spark.createDataFrame([(d, t) for d, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, 1, "z") for d, _, q in good + bad] + [(None, 1, 1, "z"), (2000, 1, 0, "z"), (2001, None, 0, "z")], "doc_id long, quality int, toxic int, text string")
    every = table.unionByName(docs.select("doc_id", "text"))
    got = {r["doc_id"]: r for r in quality.quality_scores(every, labels).collect()}
    test = [(d, q) for d, _, q in good + bad if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d, _ in test) and sum(got[d]["predicted"] == q for d, q in test) >= 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and 40 in got and 41 in got
    for some in (labels.where("quality = 1"), labels.where("false")):
        assert len({r["score"] for r in quality.quality_scores(table, some).collect()}) == 1
    assert quality.quality_scores(empty, labels).count() == 0
    model = quality.learn(every, labels)
    left = quality.keep_good(docs, model)
    assert left.columns == docs.columns and quality.keep_good(empty, model).count() == 0
    assert values(left, "doc_id") == values(quality.score(docs, model).where("score >= 0.3"), "doc_id")


def test_ratios_and_the_dual_solution():
    """Ratios against counts by hand; the model against the conditions that its optimum alone fulfils."""
    rnd = np.random.default_rng(3)
    label = (rnd.random(80) < 0.7).astype(np.int64)
    sets = [np.flatnonzero(rnd.random(64) < np.where(np.arange(64) % 3 == y, 0.3, 0.15)) for y in label]
    f, cuts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    rows = np.arange(80)
    got = quality.ratios(f, cuts, label, rows, 6)
    one = [Counter(x for s, y in zip(sets, label) if y == k for x in s.tolist()) for k in (0, 1)]
    total = [sum(c.values()) + 64 for c in one]
    assert np.allclose(got, [math.log((one[1][x] + 1) / total[1]) - math.log((one[0][x] + 1) / total[0]) for x in range(64)])
    w, bias, dual = quality.dual_descent(f, cuts, label, rows, got, 1.0, 3000, least=1e-9)
    x = np.zeros((80, 65))
    for i, s in enumerate(sets):
        x[i, s] = got[s] / math.sqrt(len(s))
    x[:, 64] = 1
    y = 2.0 * label - 1
    upper = np.where(label > 0, 1.0, (label > 0).sum() / (label == 0).sum())
    full = np.append(w, bias)
    assert np.allclose(full, (dual * y) @ x)  # the primal solution is that of the dual variables
    margin = y * (x @ full)
    assert (margin[dual < 1e-9] > 1 - 1e-5).all() and (margin[dual > upper - 1e-9] < 1 + 1e-5).all()
    inner = (dual > 1e-9) & (dual < upper - 1e-9)
    assert inner.any() and np.allclose(margin[inner], 1, atol=1e-5)


# ---- 9: language model ----------------------------------------------------------------------------------------------


def test_forward_and_counts():
    """Scaled recursions against sums over all paths, and a likelihood that doesn't fall."""
    import itertools

    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    start, move, emit = norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 6)))
    seqs = [rng.integers(0, 6, n) for n in (1, 4, 2)]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    symbols, running, order = language_model.by_step(np.concatenate(seqs), cuts, np.arange(3))
    assert running.tolist() == [3, 2, 1, 1] and order.tolist() == [1, 2, 0]
    exp = [math.log(sum(start[p[0]] * emit[p[0], s[0]] * math.prod(move[a, b] * emit[b, x] for a, b, x in zip(p, p[1:], s[1:])) for p in itertools.product(range(3), repeat=len(s)))) for s in seqs]
    assert np.allclose(language_model.forward(emit, start, move, symbols, running), [exp[i] for i in order])
    begun, moved, emitted, logs = language_model.expect(emit, start, move, symbols, running)
    assert np.isclose(begun.sum(), 3) and np.isclose(moved.sum(), 4) and np.isclose(emitted.sum(), 7) and np.isclose(logs, sum(exp), rtol=1e-5)
    assert np.allclose(emitted.sum(axis=0), np.bincount(np.concatenate(seqs), minlength=6), atol=1e-5)
    last = -np.inf
    for _ in range(20):
        begun, moved, emitted, logs = language_model.expect(emit, start, move, symbols, running)
        assert logs >= last - 1e-3
        last, start, move, emit = logs, norm(begun + 1e-12), norm(moved + 1e-12), norm(emitted + 1e-12)


def plain_model(rows, states, passes, prior=language_model.PRIOR, add=0.1):
    """Baum-Welch by loops over words, one text after another, in double: the scores of all rows, and the likelihoods of a token."""
    texts = [[*brute.WORD.findall((t or "").translate(brute.UPPER)), None] for _, t in rows]
    train = [w for (d, _), w in zip(rows, texts) if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    count = Counter(x for w in train for x in w)
    words = list(count)
    n, v = sum(count.values()), len(words)
    unknown = add / (n + add * (v + 1))
    c = np.array([count[x] for x in words], float)
    band = [min(int((int(x).bit_length() - 1) * states / max(1.0, 0.75 * math.log2(n))), states - 1) for x in c]
    lean = np.full((states, v), 0.5 / states)
    lean[band, np.arange(v)] += 0.5
    expected = lean * c
    start, move = np.full(states, 1 / states), 0.1 / states + 0.9 * np.eye(states)
    place = {x: i for i, x in enumerate(words)}

    def emit():
        known = (1 - unknown) * (expected + prior * (c + add) / (n + add * v)) / (expected.sum(axis=1, keepdims=True) + prior)
        return lambda x: known[:, place[x]] if x in place else np.full(states, unknown)

    def run(w, e):
        a, out, scale = None, [], []
        for x in w:
            a = (start if a is None else a @ move) * e(x)
            scale.append(a.sum())
            a = a / scale[-1]
            out.append(a)
        return out, scale

    history = []
    for _ in range(passes):
        e, begun, moved, new, logs = emit(), np.zeros(states), np.zeros((states, states)), np.zeros_like(expected), 0.0
        for w in train:
            alpha, scale = run(w, e)
            logs += sum(map(math.log, scale))
            beta = np.ones(states)
            for t in range(len(w) - 1, -1, -1):
                new[:, place[w[t]]] += alpha[t] * beta
                ahead = e(w[t]) * beta / scale[t]
                if t:
                    moved += np.outer(alpha[t - 1], ahead) * move
                    beta = move @ ahead
                else:
                    begun += alpha[0] * beta
        norm = lambda x: (x + 0.01) / (x + 0.01).sum(axis=-1, keepdims=True)
        start, move, expected = norm(begun), norm(moved), new
        history.append(logs / n)
    e = emit()
    return [sum(map(math.log10, run(w, e)[1])) for w in texts], history


def test_training_takes_all_rows(docs, rows, monkeypatch):
    """The same scores and likelihoods as plain passes over all texts, long ones too, in several blocks of each length."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 4000)
    exp, history = plain_model(rows, 3, 5)
    blocks, owners = language_model.coded(docs, 10)
    assert owners > 5
    model, _, _ = language_model.train(blocks, owners, 3, least=5, most=5)
    assert np.allclose(model.history, history, rtol=1e-4)
    got = language_model.language_scores(docs, states=3, least=5, most=5).collect()
    assert len(got) == len(rows)
    for (a, s), (b, r) in zip(sorted((repr(r["doc_id"]), r["score"]) for r in got), sorted((repr(d), s) for (d, _), s in zip(rows, exp))):
        assert a == b and math.isclose(s, r, rel_tol=2e-3)


def test_training_ends_when_a_pass_gains_little(docs):
    blocks, owners = language_model.coded(docs, 10)
    model, _, _ = language_model.train(blocks, owners, 3, tolerance=0.05)
    gains = np.diff(model.history)
    assert len(gains) and gains[-1] < 0.05 and (gains[:-1] >= 0.05).all() and (gains > -1e-3).all()


def test_language_model(docs, rows, empty):
    out = language_model.language_scores(docs, states=3)
    got = sorted(out.collect(), key=repr)
    exp = plain(brute.unigram(rows))
    assert [tuple(r)[:5] for r in got] == [x[:5] for x in exp]
    assert np.allclose([r["base_score"] for r in got], [x[5] for x in exp])
    assert all(r["score"] < 0 for r in got)
    train = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)
    assert language_model.language_scores(empty, states=2).count() == 0
    none = language_model.language_scores(docs, folds=1, states=2).collect()
    assert len(none) == len(rows) and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in none)


# ---- 10: shards -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("each", [1 << 20, 10])
def test_shards(docs, rows, empty, monkeypatch, each):
    monkeypatch.setattr(sharding, "ROWS_EACH", each)
    got = sharding.byte_shards(docs, 4).collect()
    exp = plain((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert plain(tuple(r)[:3] for r in got) == exp
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in shards.values())
    home = defaultdict(set)
    for r in got:
        home[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    assert sharding.byte_shards(empty, 4).count() == 0


@pytest.mark.parametrize("each,shards", [(1 << 20, 4), (10, 3), (10, 16)])
def test_shards_are_those_of_one_prefix_sum(docs, rows, monkeypatch, each, shards):
    """Each row's shard, and the order of slots, against one running sum over all groups of equal texts."""
    import xxhash

    monkeypatch.setattr(sharding, "ROWS_EACH", each)
    got = sharding.byte_shards(docs, shards).collect()
    exp, place = brute.shards(rows, shards, lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63)
    assert plain((r["doc_id"], r["text_crc32"], r["shard"]) for r in got) == plain(exp)
    for s in range(shards):
        order = [place[r["text_crc32"]] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])]
        assert order == sorted(order)


def test_shards_are_near_equal(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), (F.col("id") % 37).cast("int")).alias("text"))
    size = [r[0] for r in sharding.byte_shards(docs, 16).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(size) == 16 and max(size) / min(size) < 1.01
