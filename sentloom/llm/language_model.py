"""Op 9. A hidden Markov language model beside an additive unigram model.

States emit words. Texts are coded once: a *block* of texts of like length holds its distinct words and, step by step, which of
them each text has, so that one step of a recursion is one array operation over all texts of the block. Every Baum-Welch
pass runs over all training texts. A block adds up what its words and transitions are expected to count and sends each
word once to the word's owner, who adds up the blocks' shares and returns the sum to each block that has the word;
so the parameters grow with the vocabulary, and no task and no driver holds them all: the driver sees a few numbers a pass.
Likelihoods are exact: the forward recursion runs over whole texts, rescaled at every step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import U, Words, chunks, column
from .quality import held_out

STATES, LEAST, PASSES = 6, 2, 40
TOLERANCE = 0.05  # natural log likelihood of a token that a pass must gain for another one to follow
LEAN, STAY = 0.5, 0.9  # how far a word's count decides its state at first, and how likely a state goes on
PRIOR = 1e4  # tokens by which each state's words are drawn to those of the whole corpus
END = U(0xE5D0_FACE_0DD5_1DE5)  # the fingerprint that stands for the end of a text
STEP_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
BINS = 64  # of counts, by powers of two
FULL = 65535.0  # states' shares of a word travel as 16-bit fractions


def tokens(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of words, each text followed by END, their cuts) of texts i..j."""
    w = Words(data, offsets, i, j, lower=True)
    cuts = w.first + np.arange(j - i + 1)
    out = np.full(cuts[-1], END)
    inner = np.ones(len(out), bool)
    inner[cuts[1:] - 1] = False
    out[inner] = w.hash
    return out, cuts


def by_step(symbols: np.ndarray, cuts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, running, order) of some texts, the longest first: the first symbol of each text, then the second of each that has one, and
    so on; how many texts each step has; which text comes when."""
    size = np.diff(cuts)[texts]
    by = np.argsort(-size, kind="stable")
    order, size = texts[by], size[by]
    running = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
    step = np.repeat(np.arange(len(running)), running)
    place = np.arange(len(step)) - np.repeat(np.cumsum(running) - running, running)
    return symbols[cuts[:-1][order][place] + step].astype(np.int32), running.astype(np.int32), order


@dataclass
class Model:
    """start and move: probabilities of states; used: expected tokens of each state; seen and kinds: tokens and distinct words learnt from."""

    start: np.ndarray
    move: np.ndarray
    used: np.ndarray
    seen: int
    kinds: int
    add: float
    prior: float = PRIOR
    history: list[float] = field(default_factory=list)  # log likelihood of a token, before each pass

    @property
    def unknown(self) -> float:
        return self.add / (self.seen + self.add * (self.kinds + 1))

    def emissions(self, expected: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of each word in each state (states x words), of which `expected` are the expected counts. What the unigram
        model gives to unknown words, every state gives them; a state's other words are drawn to their shares of all tokens."""
        share = (count + self.add) / max(self.seen + self.add * self.kinds, 1e-9)
        known = (1 - self.unknown) * (expected + self.prior * share) / (self.used[:, None] + self.prior)
        return np.where(count > 0, known, self.unknown)

    def first(self, count: np.ndarray) -> np.ndarray:
        """Expected counts to begin with: words of like frequency lean to one state."""
        return first_shares(count, self.seen, len(self.start)) * count


def first_shares(count: np.ndarray, seen: int, states: int) -> np.ndarray:
    """Shares of the states in words, from each word's count alone."""
    power = np.frexp(np.maximum(count, 1).astype(float))[1] - 1
    band = np.minimum(power * states / max(1.0, 0.75 * np.log2(max(2, seen))), states - 1).astype(int)
    out = np.full((states, len(count)), (1 - LEAN) / states)
    out[band, np.arange(len(count))] += LEAN
    return out


def forward(emit: np.ndarray, start: np.ndarray, move: np.ndarray, symbols: np.ndarray, running: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each text, in double."""
    total, back = np.zeros(int(running[0]) if len(running) else 0), np.ascontiguousarray(move.T)
    lo, a = 0, None
    for m in running.tolist():
        e = emit[:, symbols[lo : lo + m]]
        a = start[:, None] * e if a is None else (back @ a[:, :m]) * e
        s = a.sum(axis=0)
        a /= s
        total[:m] += np.log(s)
        lo += m
    return total


def expect(emit: np.ndarray, start: np.ndarray, move: np.ndarray, symbols: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (states x words) of a block's texts, and their log likelihood; in single precision."""
    k, n, kind = len(start), len(symbols), np.float32
    if not n:
        return np.zeros(k), np.zeros((k, k)), np.zeros((k, emit.shape[1])), 0.0
    begin = np.cumsum(running, dtype=np.int64) - running
    symbols = symbols.astype(np.intp)
    e = emit.astype(kind)[:, symbols]
    alpha, scale = np.empty((k, n), kind), np.empty(n, kind)
    back, ahead, a = np.ascontiguousarray(move.T.astype(kind)), move.astype(kind), None
    for lo, m in zip(begin.tolist(), running.tolist()):
        part = e[:, lo : lo + m]
        a = start.astype(kind)[:, None] * part if a is None else (back @ a[:, :m]) * part
        s = a.sum(axis=0)
        a /= s
        alpha[:, lo : lo + m], scale[lo : lo + m] = a, s
    e /= scale
    beta = np.ones((k, n), kind)
    for t in range(len(running) - 1, 0, -1):
        lo, m, before = int(begin[t]), int(running[t]), int(begin[t - 1])
        part = e[:, lo : lo + m]
        part *= beta[:, lo : lo + m]
        beta[:, before : before + m] = ahead @ part
    head = int(running[0])
    before = np.arange(head, n) - np.repeat(running[:-1], running[1:])  # of each later token, the one before it
    moves = np.zeros((k, k))
    for x in range(0, len(before), 1 << 16):
        moves += alpha[:, before[x : x + (1 << 16)]] @ e[:, head + x : head + x + (1 << 16)].T
    del e
    alpha *= beta
    emissions = np.stack([np.bincount(symbols, weights=alpha[s], minlength=emit.shape[1]) for s in range(k)])
    return alpha[:, :head].sum(axis=1, dtype=float), moves * move, emissions, float(np.log(scale, dtype=float).sum())


# ---- blocks -----------------------------------------------------------------------------------------------------

CODED = pa.schema([("_bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("train", pa.binary()), ("train_running", pa.binary()), ("rest", pa.binary()), ("rest_running", pa.binary()), ("ids", pa.list_(pa.int64()))])
CODED_SQL = "_bucket int, keys binary, counts binary, train binary, train_running binary, rest binary, rest_running binary, ids array<long>"
ASKED = pa.schema([("_bucket", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("shares", pa.binary()), ("stats", pa.binary())])
ASKED_SQL = "_bucket int, owner int, n int, keys binary, counts binary, shares binary, stats binary"
TOLD = pa.schema([("_bucket", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("counts", pa.binary()), ("shares", pa.binary()), ("stats", pa.binary())])
TOLD_SQL = "_bucket int, owner int, n int, counts binary, shares binary, stats binary"


def coded(docs: DataFrame, folds: int) -> tuple[DataFrame, int]:
    """(one row for each block of texts, number of blocks), kept in the shared folder and parted by block for all passes."""
    kind = F.floor(F.log2(F.octet_length(F.coalesce(F.col(X.TEXT), F.lit(""))) + 1) / 2).cast("int")
    rows = X.corpus(docs).withColumn("held_out", held_out(folds)).withColumn("kind", kind)
    # lengths of a block differ by 4 at most, so that few of its steps have few texts
    sizes = {r["kind"]: r["b"] for r in rows.groupBy("kind").agg(F.sum(F.coalesce(F.octet_length(X.TEXT), F.lit(0))).alias("b")).collect()}  # a number for each power of 4
    many = {x: max(1, -(-b // BLOCK_BYTES)) for x, b in sizes.items()}
    blocks, begin = 0, F.lit(0)
    for x, n in sorted(many.items()):
        number = F.pmod(F.xxhash64(X.DOC, X.TEXT), F.lit(n)) + blocks
        begin = F.when(F.col("kind") == x, number).otherwise(begin)
        blocks += n

    def code(table: pa.Table) -> pa.Table:
        data, offsets = column(table.column(X.TEXT))
        parts = [tokens(data, offsets, i, j) for i, j in chunks(offsets, STEP_BYTES)]
        cuts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c) for _, c in parts]))])
        keys, symbols = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        del parts
        rest = table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        train, running, one = by_step(symbols, cuts, np.flatnonzero(~rest))
        other, other_running, two = by_step(symbols, cuts, np.flatnonzero(rest))
        counts = np.bincount(train, minlength=len(keys)).astype(np.int64)
        ids = table.column(X.DOC).cast(pa.int64()).combine_chunks().take(pa.array(np.concatenate([one, two])))
        row = [[table.column(X.BUCKET)[0].as_py()], *[[x.tobytes()] for x in (keys, counts, train, running, other, other_running)]]
        return pa.table([*[pa.array(x, f.type) for x, f in zip(row, CODED)], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], schema=CODED)

    made = rows.withColumn(X.BUCKET, begin.cast("int")).drop("kind").groupBy(X.BUCKET).applyInArrow(code, CODED_SQL)
    return X.cut_by(made, X.BUCKET), blocks


def _asks(bucket: int, keys: np.ndarray, owners: int, counts: np.ndarray, shares: np.ndarray | None, stats: np.ndarray | None) -> pa.Table:
    """A row for each owner of the block's words; stats go with the first."""
    who, cuts = X.split(keys, owners)
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    cols = [
        [bucket] * len(who), who, np.diff(cuts), [keys[a:b].tobytes() for a, b in pairs], [counts[a:b].tobytes() for a, b in pairs],
        [None if shares is None else shares[a:b].tobytes() for a, b in pairs], [None if k or stats is None else stats.tobytes() for k in range(len(who))],
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, ASKED)], schema=ASKED)


def _own(table: pa.Table, states: int) -> pa.Table:
    """An owner's sums. In the first round (no shares): of counts, with a histogram of them; later: of expected counts, with their totals."""
    sizes, words = table.column("n").to_numpy(), table.column("keys").to_pylist()
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    _, which = np.unique(np.frombuffer(b"".join(words), U), return_inverse=True)
    shares = table.column("shares").to_pylist()
    stats = [np.frombuffer(x) for x in table.column("stats").to_pylist() if x is not None]
    if shares[0] is None:
        total = np.bincount(which, weights=np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)).astype(np.int64)
        power = np.frexp(np.maximum(total, 1).astype(float))[1] - 1
        more = np.concatenate([np.bincount(power, weights=total, minlength=BINS), np.bincount(power[total > 0], minlength=BINS)])
        counts, told = total[which], None
    else:
        own = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.float32)
        part = np.frombuffer(b"".join(shares), np.uint16).reshape(-1, states)
        unit = own / np.maximum(1, part.sum(axis=1, dtype=np.int64))
        total = np.stack([np.bincount(which, weights=unit * part[:, s]) for s in range(states)])
        more = total.sum(axis=1)
        counts = total.sum(axis=0).astype(np.float32)
        told = _fractions(total, counts)[which]
        counts = counts[which]
    if stats:
        more = np.concatenate([np.sum(stats, axis=0), more])
    elif told is not None:
        more = np.concatenate([np.zeros(states + states * states + 3), more])
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    cols = [table.column("_bucket"), table.column("owner"), table.column("n")]
    answer = [[counts[a:b].tobytes() for a, b in pairs], [None if told is None else told[a:b].tobytes() for a, b in pairs], [more.tobytes()] + [None] * (len(pairs) - 1)]
    return pa.table([*[c.cast(f.type) for c, f in zip(cols, TOLD)], *[pa.array(c, pa.binary()) for c in answer]], schema=TOLD)


def _fractions(expected: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The states' shares of each word (words x states) in 16 bits."""
    return np.minimum(FULL, np.rint(expected * (FULL / np.maximum(counts, 1e-30)))).astype(np.uint16).T.copy()


def _told(table: pa.Table, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(expected counts, states x words; counts) of a block's words, as their owners told."""
    order = np.argsort(table.column("owner").to_numpy(), kind="stable")
    blobs = lambda c: b"".join(x for x in table.column(c).take(pa.array(order)).to_pylist())
    if not table.num_rows or table.column("shares")[0].as_py() is None:
        count = np.frombuffer(blobs("counts"), np.int64)
        return model.first(count), count
    count = np.frombuffer(blobs("counts"), np.float32)
    part = np.frombuffer(blobs("shares"), np.uint16).reshape(len(count), -1)
    return (part * (count / np.maximum(1, part.sum(axis=1, dtype=np.int64)))[:, None]).T, np.rint(count)


def _summed(told: DataFrame) -> np.ndarray | None:
    """The owners' statistics added up, in 32 parts on the executors and then here."""

    def add_up(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table.column("stats").to_pylist()], axis=0)
        return pa.table([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "stats"])

    parts = told.where("stats is not null").select(F.pmod("owner", F.lit(32)).alias("part"), "stats").groupBy("part").applyInArrow(add_up, "part int, stats binary")
    got = parts.collect()  # 32 rows at most
    return np.sum([np.frombuffer(r["stats"]) for r in got], axis=0) if got else None


# ---- training and scoring ---------------------------------------------------------------------------------------


def train(blocks: DataFrame, owners: int, states: int = STATES, add: float = 0.1, least: int = LEAST, most: int = PASSES, tolerance: float = TOLERANCE) -> tuple[Model, DataFrame, DataFrame]:
    """(model, words' counts, words' expected counts), the tables as told to each block.

    Baum-Welch over all training texts in every pass: `least` passes, and then until one starts from a likelihood that is less than
    `tolerance` a token above the one before, or `most` were made.
    """

    def ask(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        return _asks(row["_bucket"], np.frombuffer(row["keys"], U), owners, np.frombuffer(row["counts"], np.int64), None, None)

    def own(table: pa.Table) -> pa.Table:
        return _own(table, states)

    def step_of(model: Model):
        def step(table: pa.Table, said: pa.Table) -> pa.Table:
            if not table.num_rows:
                return ASKED.empty_table()
            row = table.to_pylist()[0]
            expected, count = _told(said, model)
            begun, moved, emitted, logs = expect(model.emissions(expected, count), model.start, model.move, np.frombuffer(row["train"], np.int32), np.frombuffer(row["train_running"], np.int32))
            own = np.frombuffer(row["counts"], np.int64)
            stats = np.concatenate([begun, moved.ravel(), [logs, begun.sum(), own.sum()]])
            return _asks(row["_bucket"], np.frombuffer(row["keys"], U), owners, own.astype(np.float32), _fractions(emitted, own), stats)

        return step

    counts = X.cut(blocks.select("_bucket", "keys", "counts").groupBy(X.BUCKET).applyInArrow(ask, ASKED_SQL).groupBy("owner").applyInArrow(own, TOLD_SQL))
    got = _summed(counts)
    got = np.zeros(2 * BINS) if got is None else got
    seen, kinds = int(got[:BINS].sum()), int(got[BINS:].sum())
    used = first_shares(2 ** np.arange(BINS, dtype=float), seen, states) @ got[:BINS]
    model = Model(np.full(states, 1 / states), (1 - STAY) / states + STAY * np.eye(states), used, seen, kinds, add)
    told = counts
    norm = lambda x: (x + 0.01) / (x + 0.01).sum(axis=-1, keepdims=True)
    while seen and len(model.history) < most:
        texts = blocks.select("_bucket", "keys", "counts", "train", "train_running")
        asked = texts.groupBy(X.BUCKET).cogroup(told.drop("stats").groupBy(X.BUCKET)).applyInArrow(step_of(model), ASKED_SQL)
        before, told = told, X.cut(asked.groupBy("owner").applyInArrow(own, TOLD_SQL))
        if before is not counts:
            X.release(before)
        got = _summed(told)
        a, b = states, states + states * states
        now = float(got[b] / got[b + 2])
        model = Model(norm(got[:a]), norm(got[a:b].reshape(states, states)), got[b + 3 :], seen, kinds, add, model.prior, [*model.history, now])
        if len(model.history) >= max(2, least) and now - model.history[-2] < tolerance:
            break
    return model, counts, told


def language_scores(docs: DataFrame, folds: int = 10, add: float = 0.1, states: int = STATES, least: int = LEAST, most: int = PASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, followed by one end; a null or empty text is the end alone. Both models
    learn from all rows outside the held-out fold (crc32 of doc_id mod folds is 0). base_score is the sum of
    log10((c + add) / (N + add * (V + 1))); score is the hidden Markov model's log10 probability of the text, in which every state gives
    unknown words what the unigram model gives them. Rows that repeat a doc_id are texts of their own; a null doc_id is in the fold of an
    empty string. Without training rows c, N and V are 0 and all scores 0. Words are told apart by 64-bit fingerprints. A task holds about
    100 bytes for each token of one block, or of one text if that is longer. Other columns are ignored.
    """
    blocks, owners = coded(docs, folds)
    model, counts, told = train(blocks, owners, states, add, least, most, tolerance)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        row = table.drop_columns(["ids"]).to_pylist()[0]
        last = said.column("last").to_numpy(zero_copy_only=False).astype(bool)
        _, count = _told(said.filter(pa.array(~last)), model)
        expected, _ = _told(said.filter(pa.array(last)), model)
        emit = model.emissions(expected, count)
        base, known = np.log10((count + add) / (model.seen + add * (model.kinds + 1))), (count > 0).astype(np.int64)
        size, sums, hits, full, held = [], [], [], [], []
        for name in ("train", "rest"):
            symbols, running = np.frombuffer(row[name], np.int32), np.frombuffer(row[f"{name}_running"], np.int32)
            n = int(running[0]) if len(running) else 0
            full.append(forward(emit, model.start, model.move, symbols, running) / np.log(10))
            size.append(np.searchsorted(-running, -np.arange(n), "left"))
            total, some, lo = np.zeros(n), np.zeros(n, np.int64), 0
            for m in running.tolist():
                at = symbols[lo : lo + m]
                total[:m] += base[at]
                some[:m] += known[at]
                lo += m
            sums.append(total)
            hits.append(some)
            held.append(np.full(n, name == "rest"))
        cat = np.concatenate
        return pa.table([table.column("ids").combine_chunks().flatten(), pa.array(cat(held)), pa.array(cat(size), pa.int64()), pa.array(cat(hits)), pa.array(np.full(len(cat(held)), model.seen), pa.int64()), pa.array(cat(sums)), pa.array(cat(full))], schema=schema)

    said = counts.select("_bucket", "owner", "n", "counts", "shares", F.lit(False).alias("last")).unionByName(told.select("_bucket", "owner", "n", "counts", "shares", F.lit(True).alias("last")))
    sql = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.drop("counts").groupBy(X.BUCKET).cogroup(said.groupBy(X.BUCKET)).applyInArrow(score, sql)
