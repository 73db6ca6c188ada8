"""A gated recurrent language model over words, and the unigram scores it is held against."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, in_batches, small_arrow_batches, written

#: The end of a document, as a word that no text can hold.
END = b" "
#: Words the network tells apart, in CLASSES classes of equal number; all other words fall into TAILS classes by their last two bytes.
MODEL, CLASSES, TAILS = 1024, 16, 32
#: Words whose counts travel to the tasks; rarer ones are joined.
HEAD = 100_000
HIDDEN, LANES, STEPS = 16, 384, 16
_LN10 = float(np.log(10.0))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def _together(batches, most: int = 1 << 23):
    """Lists of Arrow batches (text first) of about `most` bytes of text together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(0).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat, count = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(count)), count)
    return flat.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(count))


def word_counts(docs: DataFrame, most: int = 1 << 24) -> DataFrame:
    """(word binary, c) over whole texts, with END for each document. Tasks add up about `most` bytes of text at a time before the shuffle."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches):
        for held in _together(batches, most):
            found = pc.value_counts(pa.chunked_array([_cut(b.column(0))[0] for b in held], pa.string()))
            ends = sum(b.num_rows for b in held)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([found.field("counts"), pa.array([ends], pa.int64())])], schema=schema)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The commonest words, their counts, and what is needed of the rest.

    code of a word: its place by count; below MODEL it is a word of the network (place 0 is END), above it falls into a
    tail class. tail_tokens and tail_words: counts of all words of each tail class.
    """

    codes: dict[bytes, int]
    counts: np.ndarray
    tail: np.ndarray
    tokens: int
    distinct: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))


def commonest(counts: DataFrame, most: int, buckets: int = 4096) -> list[DataFrame]:
    """The `most` words (word, c) of the largest counts (all, if fewer), in parts; ties go by a hash into `buckets`, then by word.

    Each part is a filter that histograms find: whole steps of eight to a doubling, whole counts of the next step, whole
    buckets of the next count; only in one bucket words are sorted, so no number of ties makes one large sort.
    """
    step, bucket = F.floor(F.log2("c") * 8), F.pmod(F.xxhash64("word"), F.lit(buckets))
    rest, parts = counts.filter("c > 0"), []
    for level, falling in ((step, True), (F.col("c"), True), (bucket, False)):
        cut = None
        for at, n in sorted(rest.groupBy(level.alias("at")).agg(F.count("*")).collect(), reverse=falling):
            if n > most:
                break
            most, cut = most - n, at
        else:
            return [*parts, rest]
        if cut is not None:
            parts.append(rest.filter(level >= cut if falling else level <= cut))
        rest = rest.filter(level == at)
    return [*parts, rest.orderBy("word").limit(most)]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From written counts; the driver gets the HEAD commonest words (see commonest()), TAILS rows of sums and the totals."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    top = sorted((r for part in commonest(counts.filter(F.col("word") != F.lit(END)), HEAD) for r in part.collect()), key=lambda r: (-r.c, bytes(r.word)))
    end = counts.filter(F.col("word") == F.lit(END)).select("c").first()
    rows = [(END, end[0] if end else 0)] + [(bytes(r.word), r.c) for r in top]
    own = {w for w, _ in rows[:MODEL]}
    sums = counts.groupBy((F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % TAILS).alias("j")).agg(F.sum("c"), F.count("*")).collect()
    tokens, distinct_tail = np.zeros(TAILS), np.zeros(TAILS)
    for j, c, n in sums:
        tokens[j], distinct_tail[j] = c, n
    for w, c in rows[:MODEL]:
        if c:
            tokens[tail_class(w)] -= c
            distinct_tail[tail_class(w)] -= 1
    return Vocabulary({w: k for k, (w, _) in enumerate(rows)}, np.array([c for _, c in rows], float), np.array([-1 if w in own else tail_class(w) for w, _ in rows]), int(total or 0), distinct, tokens, distinct_tail)


@dataclass
class Network:
    """Weights: x (input word -> three gates), u (state -> gates), c and d (state -> class, its bias), w and v (state -> word, its bias)."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    d: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.d, self.w, self.v]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def of(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)


def first_network(vocab: Vocabulary, seed: int = 7) -> Network:
    """Small weights; the biases are those of the counts, so that the untrained model is close to a unigram model by classes."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(MODEL)
    counts[: min(MODEL, len(vocab.counts))] = vocab.counts[:MODEL]
    counts += 0.5
    by_class = counts.reshape(CLASSES, -1)
    mass = np.concatenate([by_class.sum(axis=1), vocab.tail_tokens + 0.5])
    small = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(small(0.3, MODEL + TAILS, 3 * HIDDEN), small(0.1, HIDDEN, 3 * HIDDEN), small(0.05, HIDDEN, CLASSES + TAILS), np.log(mass / mass.sum()).astype(np.float32), small(0.05, MODEL, HIDDEN), np.log(by_class / by_class.sum(axis=1, keepdims=True)).ravel().astype(np.float32))


def _gates(a: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit from the input's part of the gates; the new state and what the way back needs."""
    cut = 2 * HIDDEN
    g = h @ u
    zr = a[:, :cut] + g[:, :cut]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = r * g[:, cut:]
    n += a[:, cut:]
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, z, r, n, g[:, cut:]


def _exponentials(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place: exponentials of logits (bounded, as no more than that is ever likely), their sums; and log P(target)."""
    np.minimum(logits, np.float32(80), out=logits)
    own = logits[np.arange(len(logits)), target]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return sums, own - np.log(sums)


def output(net: Network, h: np.ndarray, target: np.ndarray, slopes: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of P(class) P(word | class) for targets (words of the network, or MODEL + tail class: the class alone).

    With slopes, adds the slopes of the negated sum to them and returns that of the states too.
    """
    per = MODEL // CLASSES
    kind = np.where(target < MODEL, target // per, target - MODEL + CLASSES).astype(np.int16)
    p = h @ net.c
    p += net.d
    sums, out = _exponentials(p, kind)
    back = None
    if slopes is not None:
        p /= sums[:, None]
        p[np.arange(len(p)), kind] -= 1
        slopes.c += h.T @ p
        slopes.d += p.sum(axis=0)
        back = p @ net.c.T
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    states, words_ = h[order[: bounds[-1]]], target[order[: bounds[-1]]] % per
    gains, backs = np.zeros(len(states), out.dtype), None if slopes is None else np.zeros_like(states)
    for k in range(CLASSES):
        lo, hi = bounds[k], bounds[k + 1]
        if lo == hi:
            continue
        at, state, word = slice(k * per, (k + 1) * per), states[lo:hi], words_[lo:hi]
        q = state @ net.w[at].T
        q += net.v[at]
        sums, gains[lo:hi] = _exponentials(q, word)
        if slopes is not None:
            q /= sums[:, None]
            q[np.arange(hi - lo), word] -= 1
            slopes.w[at] += q.T @ state
            slopes.v[at] += q.sum(axis=0)
            backs[lo:hi] = q @ net.w[at]
    out[order[: bounds[-1]]] += gains
    if slopes is not None:
        back[order[: bounds[-1]]] += backs
    return out, back


def lay_out(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and first step of each document: longest first, into the lane that is free first."""
    lanes = max(1, min(lanes, len(lengths), int(lengths.sum() // max(1, lengths.max(initial=1)) + 1)))
    free, lane, start = np.zeros(lanes, np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        k = int(free.argmin())
        lane[d], start[d] = k, free[k]
        free[k] += lengths[d]
    return lane, start


def grid(ids: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets and inputs by step and lane (-1: nothing), and whether a document starts there. An input is the word before; END starts."""
    lengths = np.array([len(i) for i in ids], np.int64)
    lane, start = lay_out(lengths, lanes)
    steps = int((start + lengths).max())
    target = np.full((steps, lane.max() + 1), -1, np.int32)
    for i, k, s in zip(ids, lane.tolist(), start.tolist()):
        target[s : s + len(i), k] = i
    came = np.zeros_like(target)
    came[1:] = target[:-1]
    fresh = np.zeros(target.shape, bool)
    fresh[start, lane] = True
    came[fresh] = 0
    return target, np.maximum(came, 0), fresh


def likelihoods(net: Network, ids: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """log10 probability of each document's words (at least one), its state carried from window to window to its end."""
    target, came, fresh = grid(ids, lanes)
    doc = np.full(target.shape, -1, np.int32)
    lengths = np.array([len(i) for i in ids], np.int64)
    lane, start = lay_out(lengths, lanes)
    for d, (k, s) in enumerate(zip(lane.tolist(), start.tolist())):
        doc[s : s + lengths[d], k] = d
    h, total, lo = np.zeros((target.shape[1], HIDDEN), np.float32), np.zeros(len(ids)), 0
    while lo < len(target):
        live = target[lo] >= 0
        if live.sum() <= 0.75 * len(live):
            target, came, fresh, doc, h = target[:, live], came[:, live], fresh[:, live], doc[:, live], h[live]
        window = min(max(1, 65536 // target.shape[1]), len(target) - lo)
        states, starts = np.empty((window, *h.shape), np.float32), fresh[lo : lo + window].any(axis=1)
        for t in range(window):
            if starts[t]:
                h = np.where(fresh[lo + t][:, None], np.float32(0), h)
            h = _gates(net.x[came[lo + t]], h, net.u)[0]
            states[t] = h
        real = target[lo : lo + window] >= 0
        got, _ = output(net, states[real], target[lo : lo + window][real])
        total += np.bincount(doc[lo : lo + window][real], got, len(ids))
        lo += window
    return total / _LN10


class Trainer:
    """Truncated backpropagation over windows of STEPS words (more where documents are few) in LANES documents at a time, with steps by the running means of slopes and of their squares."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate = Network(*(p.copy() for p in net.parts())), rate
        self.mean, self.square = (Network(*(np.zeros_like(p) for p in net.parts())) for _ in range(2))
        self.words = self.turns = 0

    def learn(self, ids: list[np.ndarray], lanes: int = LANES) -> None:
        """One pass over documents, each with a state that runs on to its end. Where fewer lanes are left, windows have more steps in place."""
        target, came, fresh = grid(ids, lanes)
        h, lo = np.zeros((target.shape[1], HIDDEN), np.float32), 0
        while lo < len(target):
            live = target[lo] >= 0
            if live.sum() <= 0.75 * len(live):
                target, came, fresh, h = target[:, live], came[:, live], fresh[:, live], h[live]
            steps = STEPS * max(1, min(32, lanes // target.shape[1]))
            h = self._window(target[lo : lo + steps], came[lo : lo + steps], fresh[lo : lo + steps], h)
            lo += steps

    def slopes(self, target: np.ndarray, came: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[Network, np.ndarray, float]:
        """Slopes of the negated log probability of a window, the state after it, and that sum."""
        net, cut = self.net, 2 * HIDDEN
        slopes = Network(*(np.zeros_like(p) for p in net.parts()))
        kind, shape = net.u.dtype, (len(target), *h.shape)
        before, z, r, n, g, states = (np.empty(shape, kind) for _ in range(6))
        inputs, starts = net.x[came], fresh.any(axis=1)
        for t in range(len(target)):
            before[t] = np.where(fresh[t][:, None], kind.type(0), h) if starts[t] else h
            h, z[t], r[t], n[t], g[t] = _gates(inputs[t], before[t], net.u)
            states[t] = h
        real = target >= 0
        if whole := bool(real.all()):
            got, back = output(net, states.reshape(-1, HIDDEN), target.ravel(), slopes)
            into = back.reshape(shape)
        else:
            got, back = output(net, states[real], target[real], slopes)
            into = np.zeros_like(states)
            into[real] = back
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), g * r * (1 - r)
        dh, da, dg = np.zeros_like(h), np.empty((*target.shape, 3 * HIDDEN), kind), np.empty(shape, kind)
        for t in range(len(target) - 1, -1, -1):
            dh = dh + into[t]
            dn = dh * by_n[t]
            da[t, :, :HIDDEN], da[t, :, HIDDEN:cut], da[t, :, cut:] = dh * by_z[t], dn * by_r[t], dn
            np.multiply(dn, r[t], out=dg[t])
            dh = dh * z[t] + da[t, :, :cut] @ net.u[:, :cut].T + dg[t] @ net.u[:, cut:].T
            if starts[t]:
                dh[fresh[t]] = 0
        rows = before.reshape(-1, HIDDEN).T
        slopes.u[:, :cut] = rows @ da.reshape(-1, 3 * HIDDEN)[:, :cut]
        slopes.u[:, cut:] = rows @ dg.reshape(-1, HIDDEN)
        words_, flat = (came.ravel(), da.reshape(-1, 3 * HIDDEN)) if whole else (came[real], da[real])
        if len(flat):
            order = np.argsort(words_.astype(np.int16), kind="stable")
            words_ = words_[order]
            first = np.flatnonzero(np.concatenate([[True], words_[1:] != words_[:-1]]))
            slopes.x[words_[first]] = np.add.reduceat(flat[order], first, axis=0)
        return slopes, h, float(got.sum())

    def _window(self, target, came, fresh, h):
        slopes, h, _ = self.slopes(target, came, fresh, h)
        n = max(1, int((target >= 0).sum()))
        self.turns += 1
        # windows of few words, at the ends of long documents, take smaller steps
        rate = np.float32(self.rate * np.sqrt(n / (n + 512)) * np.sqrt(1 - 0.99**self.turns) / (1 - 0.9**self.turns))
        for p, s, mean, square in zip(self.net.parts(), slopes.parts(), self.mean.parts(), self.square.parts()):
            s /= n
            mean += 0.1 * (s - mean)
            square += 0.01 * (s * s - square)
            p -= rate * mean / (np.sqrt(square) + np.float32(1e-6))
        self.words += n
        return h


def coded(vocab: Vocabulary, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Of each text: codes of its words and its end (-1: not among the commonest), their words of the network or MODEL + tail class, and the words of code -1."""
    flat, count = _cut(texts)
    found = flat.dictionary_encode()
    names, index = found.dictionary.cast(pa.binary()).to_pylist(), found.indices.to_numpy(zero_copy_only=False)
    code = np.fromiter(map(vocab.codes.get, names, repeat(-1)), np.int32, len(names))
    ids = np.where(code < MODEL, code, MODEL + vocab.tail[code]).astype(np.int32)
    new = np.flatnonzero(code < 0)
    ids[new] = [MODEL + tail_class(names[k]) for k in new.tolist()]
    ends = np.cumsum(count)
    codes, words_ = np.insert(code[index], ends, 0), np.insert(ids[index], ends, 0)
    rare = code[index] < 0
    words_of_rare = flat.filter(pa.array(rare)).cast(pa.binary())
    rare_ends = np.concatenate([[0], np.cumsum(rare)])[ends]
    cuts, rare_cuts = [0, *(ends + np.arange(1, len(ends) + 1)).tolist()], [0, *rare_ends.tolist()]
    return [(codes[a:b], words_[a:b], words_of_rare.slice(c, d - c)) for a, b, c, d in zip(cuts, cuts[1:], rare_cuts, rare_cuts[1:])]


def pooled(rows, size, most: int = 3 << 17, count: int = LANES):
    """Lists of rows of alike size (within a factor of four): `count` rows and `most` size together, or eight times that size; so lanes are many and end together. What is left at the end is one list."""
    pools: dict[int, list] = {}
    sums: Counter[int] = Counter()
    for row in rows:
        k = max(8, size(row).bit_length()) // 2
        pools.setdefault(k, []).append(row)
        sums[k] += size(row)
        if sums[k] >= most and len(pools[k]) >= count or sums[k] >= 8 * most:
            yield pools.pop(k)
            sums.pop(k)
    if left := [row for k in sorted(pools, reverse=True) for row in pools[k]]:
        yield left


def train(docs: DataFrame, vocab, net: Network, rate: float) -> Network:
    """The mean, by words seen, of networks that tasks train from `net`, each over all its documents once.

    Weights travel in pieces and are added up in two shuffles, so no task or driver holds more than some networks.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    size, piece = len(net.flat()), 4096
    schema = "piece int, part int, n double, w array<float>"

    def run(batches):
        trainer = Trainer(shared.value, rate)
        ids = (i for held in _together(batches) for _, i, _ in coded(vocab.value, pa.concat_arrays([b.column(0).cast(pa.string()) for b in held])))
        for part in pooled(ids, len):
            trainer.learn(part)
        if trainer.words:
            flat = trainer.net.flat().astype(np.float32)
            pieces = [flat[at : at + piece] for at in range(0, size, piece)]
            k, part = len(pieces), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([float(trainer.words)] * k), pa.array(pieces, pa.list_(pa.float32()))], names=["piece", "part", "n", "w"])

    def added(frame):
        n = float(frame["n"].sum())
        out = frame.iloc[:1].copy()
        w = np.zeros(len(out["w"].iloc[0]))
        for share, own in zip(frame["n"], frame["w"]):
            w += np.asarray(own, np.float64) * (share / n)
        out["n"], out["w"] = n, [w.astype(np.float32)]
        return out

    tasks = docs.select("text").mapInArrow(run, schema).withColumn("salt", F.col("part") % 32)
    some = tasks.groupBy("piece", "salt").applyInPandas(lambda f: added(f[["piece", "part", "n", "w"]]), schema)
    rows = some.groupBy("piece").applyInPandas(added, schema).collect()
    if not rows:
        return net
    return net.of(np.concatenate([np.array(r.w, np.float32) for r in sorted(rows, key=lambda r: r.piece)]))


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts cover all training documents, and so does the network's training: first a pass over one document in eight
    from equal starts, whose mean is the start of a pass over all. A word outside the network has the probability of its
    tail class times its smoothed share of the class's count. Null and empty texts are the end alone; without training
    documents the score is the base score, and an empty table gives no rows. Repeated rows are rows of their own, a null
    doc_id is in the fold of the empty text. The state runs on to the end of a text of any length, in training too, where
    only slopes are cut. Counts of words that are not among the HEAD commonest are joined, never broadcast. Other columns
    do not matter.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    fold = id_remainder(folds)
    learning = docs.select("doc_id", "text").filter(fold != held)
    counts = written(word_counts(learning), "counts")
    plain = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(plain)
    net = first_network(plain)
    if plain.tokens:
        net = train(learning.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(8)) == 0), vocab, net, 0.02)
        net = train(learning, vocab, net, 0.01)
    shared = spark.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])

    def run(batches):
        v = vocab.value
        norm = np.log10(v.tail_tokens + v.tail_words + 1)

        def coded_rows(held):
            column = pa.concat_arrays([b.column(0).cast(pa.string()) for b in held])
            ids = [i for b in held for i in b.column(1).to_pylist()]
            for doc_id, (codes, words_, rare) in zip(ids, coded(v, column)):
                yield doc_id, words_, codes, rare

        def measured(part):
            got = likelihoods(shared.value, [i for _, i, _, _ in part])
            for (doc_id, ids, codes, rare), s in zip(part, got.tolist()):
                c = v.counts[codes[codes >= 0]]
                base = float(np.log10(c + 1).sum()) - len(codes) * np.log10(v.tokens + v.distinct + 1)
                tails = ids[ids >= MODEL] - MODEL
                s += float(np.log10(v.counts[codes[codes >= MODEL]] + 1).sum()) - float(norm[tails].sum())
                yield doc_id, len(codes), int((c > 0).sum()), base, s, rare.to_pylist()

        def rows():
            texts = (r for held in _together(batches) for r in coded_rows(held))
            for part in pooled(texts, lambda r: len(r[1])):
                yield from measured(part)

        yield from in_batches(rows(), schema, 512)

    fields = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    scored = docs.select("text", F.col("doc_id").cast("long")).mapInArrow(run, fields)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    rest = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    all_rows = scored.drop("rare").join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("base_score") + more
    return all_rows.select(
        "doc_id", (fold == held).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(plain.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + more if plain.tokens else base).alias("score"),
    )


def op9_gru_lm(docs: DataFrame) -> DataFrame:
    """score() with the folds and columns of the query; see there for nulls, empty and long texts."""
    return score(docs)
