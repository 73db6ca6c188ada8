"""A linear-chain conditional random field over words that marks toxic spans and scores documents."""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, released, small_arrow_batches, text_rows, written
from .pretokens import by_size

_BLANK = bytes(ord(" ") if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_STEPS = 64
#: Bytes of a word that make its stem, so that forms of a word share what is learned.
STEM = 5


def words(text: str) -> list[bytes]:
    """Lower-case words of a text; ASCII marks and blanks part them."""
    return text.encode().translate(_BLANK).split()


@dataclass
class Model:
    """Weights by word, stem and neighbours, of moves between states (0 clean, 1 toxic), and of the document's sums."""

    vocabulary: dict[bytes, int]
    stems: dict[bytes, int]
    stem_of: np.ndarray
    own: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray
    document: np.ndarray
    prior: float


class Chains:
    """Documents as rows of 64 positions, so that numpy takes a step in all rows at once; a document's rows follow each other."""

    def __init__(self, lengths: np.ndarray):
        rows = np.maximum(1, -(-lengths // _STEPS))
        self.doc = np.repeat(np.arange(len(lengths)), rows)
        self.first = np.cumsum(rows) - rows
        self.rank = np.arange(len(self.doc)) - self.first[self.doc]
        n = np.clip(lengths[self.doc] - self.rank * _STEPS, 0, _STEPS)
        self.mask = np.arange(_STEPS)[:, None] < n[None, :]
        starts = np.cumsum(lengths) - lengths
        self.place = np.where(self.mask, (starts[self.doc] + self.rank * _STEPS)[None, :] + np.arange(_STEPS)[:, None], -1)
        self.order = np.argsort(self.rank, kind="stable")
        self.bounds = np.searchsorted(self.rank[self.order], np.arange(self.rank.max(initial=0) + 2))

    def marginals(self, score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(toxic) of each word, expected counts of moves (2 x 2), log of the sum over all taggings.

        score: how much each word speaks for toxic. Exact for whole documents: the product of a row's step matrices is
        taken first, rows of a document pass their messages on, then each row runs forward and backward from them.
        """
        e = np.exp(np.clip(np.append(score, 0.0), -30, 30))[self.place]  # the last value stands for no word
        t = np.exp(moves)
        mask, n = self.mask, len(self.doc)
        step = lambda a0, a1, k: (np.where(mask[k], a0 * t[0, 0] + a1 * t[1, 0], a0), np.where(mask[k], (a0 * t[0, 1] + a1 * t[1, 1]) * e[k], a1))
        product, logs = np.zeros((n, 2, 2)), np.zeros((2, n))
        for s in range(2):
            a0, a1 = np.full(n, 1.0 - s), np.full(n, float(s))
            for k in range(_STEPS):
                a0, a1 = step(a0, a1, k)
                if k % 4 == 3:
                    z = a0 + a1
                    a0, a1 = a0 / z, a1 / z
                    logs[s] += np.log(z)
            product[:, s, 0], product[:, s, 1] = a0, a1
        product[:, 1, :] *= np.exp(np.clip(logs[1] - logs[0], -600, 600))[:, None]
        enter, leave = np.zeros((n, 2)), np.ones((n, 2))
        enter[self.first, 0] = 1.0
        for r in range(1, len(self.bounds) - 1):
            own = self.order[self.bounds[r] : self.bounds[r + 1]]
            got = np.einsum("is,ist->it", enter[own - 1], product[own - 1])
            enter[own] = got / got.sum(axis=1, keepdims=True)
        for r in range(len(self.bounds) - 2, 0, -1):
            own = self.order[self.bounds[r] : self.bounds[r + 1]]
            got = np.einsum("ist,it->is", product[own], leave[own])
            leave[own - 1] = got / got.sum(axis=1, keepdims=True)
        a0, a1 = enter[:, 0].copy(), enter[:, 1].copy()
        forward, total = np.zeros((_STEPS + 1, 2, n)), 0.0
        forward[0] = a0, a1
        for k in range(_STEPS):
            a0, a1 = step(a0, a1, k)
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            total += float(np.log(z).sum())
            forward[k + 1] = a0, a1
        b0, b1 = leave[:, 0].copy(), leave[:, 1].copy()
        p, expected = np.zeros((_STEPS, n)), np.zeros((2, 2))
        for k in range(_STEPS - 1, -1, -1):
            f0, f1 = forward[k + 1]
            z = f0 * b0 + f1 * b1
            p[k] = f1 * b1 / z
            g0, g1 = forward[k]
            u0, u1 = b0, e[k] * b1
            m = [g0 * t[0, 0] * u0, g0 * t[0, 1] * u1, g1 * t[1, 0] * u0, g1 * t[1, 1] * u1]
            z = m[0] + m[1] + m[2] + m[3]
            expected += np.array([float((x / z)[mask[k]].sum()) for x in m]).reshape(2, 2)
            c0, c1 = t[0, 0] * u0 + t[0, 1] * u1, t[1, 0] * u0 + t[1, 1] * u1
            z = c0 + c1
            b0, b1 = np.where(mask[k], c0 / z, b0), np.where(mask[k], c1 / z, b1)
        out = np.zeros(len(score))
        out[self.place[mask]] = p[mask]
        return out, expected, total


def _shifted(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and after each; 0 at the edges of documents."""
    before, after = np.zeros_like(ids), np.zeros_like(ids)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    ends = np.cumsum(lengths[lengths > 0])
    before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = 0
    after[ends - 1] = 0
    return before, after


def _features(vocabulary: dict[bytes, int], stems: dict[bytes, int], stem_of: np.ndarray, cut: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words and of their stems; 0 for those that are not known."""
    flat = [w for c in cut for w in c]
    ids = np.fromiter(map(vocabulary.get, flat, repeat(0)), np.int64, len(flat))
    parts = stem_of[ids]
    new = np.flatnonzero(ids == 0)
    parts[new] = [stems.get(flat[k][:STEM], 0) for k in new.tolist()]
    return ids, parts


def _sums(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, expected toxic words, the largest marginal, their density."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    expected = np.bincount(doc, p, len(lengths))
    most = np.zeros(len(lengths))
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(len(lengths)), np.log1p(expected), most, np.log1p(1000 * expected / np.maximum(lengths, 1))], axis=1)


def fit(texts: list[str], toxic: list[int], least_docs: int = 3, least_odds: float = 1.3, rounds: int = 40, share: float | None = None) -> Model:
    """A model from labelled documents.

    Word labels come from document labels: a word of a toxic document is toxic if it or its stem stands in least_docs
    toxic documents and its log odds of standing in toxic against clean ones, less two standard errors, reach least_odds;
    all else is clean. The field's likelihood is
    raised by steps of the sign of its gradient with growing or shrinking size, then a logistic regression takes the sums.
    There a document counts by how rare its label is in the sample against `share`, the share of toxic ones where the
    sample comes from (the sample's own if not given). Without both labels the score of every text is that share.
    """
    y = np.array(toxic, np.int64)
    own_share = float(y.mean()) if len(y) else 0.0
    prior = own_share if share is None else share
    if not 0 < own_share < 1 or not 0 < prior < 1:
        return Model({}, {}, np.zeros(1, np.int64), *[np.zeros(1)] * 4, np.zeros((2, 2)), np.zeros(4), prior)
    same: dict[bytes, bytes] = {}
    cut = [[same.setdefault(w, w) for w in words(t)] for t in texts]  # one object for each word: the sample is on the driver

    def table(parts) -> tuple[dict[bytes, int], np.ndarray]:
        """Numbers of what stands in least_docs documents, from 1, and which of them are marked as toxic."""
        seen: dict[bytes, list[int]] = {}
        for ws, label in zip(cut, toxic):
            for w in parts(ws):
                seen.setdefault(w, [0, 0])[label] += 1
        numbers = {w: k for k, w in enumerate(sorted(w for w, c in seen.items() if sum(c) >= least_docs), 1)}
        counts = np.array([[0, 0], *(seen[w] for w in numbers)], float)
        odds = np.log((counts[:, 1] + 0.5) / (y.sum() + 1)) - np.log((counts[:, 0] + 0.5) / (len(y) - y.sum() + 1))
        error = np.sqrt(1 / (counts[:, 1] + 0.5) + 1 / (counts[:, 0] + 0.5))
        marked = (counts[:, 1] >= least_docs) & (odds - 2 * error >= least_odds)
        marked[0] = False
        return numbers, marked

    vocabulary, marked = table(set)
    stems, marked_stem = table(lambda ws: {w[:STEM] for w in ws})
    stem_of = np.array([0, *(stems.get(w[:STEM], 0) for w in vocabulary)], np.int64)
    lengths = np.array([len(c) for c in cut], np.int64)
    ids, parts = _features(vocabulary, stems, stem_of, cut)
    del cut, same
    truth = ((marked[ids] | marked_stem[parts]) & np.repeat(y == 1, lengths)).astype(float)
    before, after = _shifted(ids, lengths)
    chains, size = Chains(lengths), len(vocabulary) + 1
    starts = np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]
    came = np.concatenate([[0.0], truth[:-1]])
    came[starts] = 0.0
    moved = np.array([[((1 - came) * (1 - truth)).sum(), ((1 - came) * truth).sum()], [(came * (1 - truth)).sum(), (came * truth).sum()]])
    at = np.cumsum([0, size, size, size, len(stems) + 1, 4])
    weights = np.zeros(at[-1])
    weights[at[4] + 1] = -4.0
    step, last = np.full(len(weights), 0.1), np.zeros(len(weights))

    def marginals():
        own, pre, post, stem, moves = np.split(weights, at[1:-1])
        return chains.marginals(own[ids] + pre[before] + post[after] + stem[parts], moves.reshape(2, 2))

    for _ in range(rounds):
        p, expected, _ = marginals()
        off = truth - p
        slope = np.concatenate([np.bincount(ids, off, size), np.bincount(before, off, size), np.bincount(after, off, size), np.bincount(parts, off, len(stems) + 1), (moved - expected).ravel()])
        slope -= 0.1 * weights
        same = np.sign(slope) * np.sign(last)
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        last = np.where(same < 0, 0.0, slope)
        weights += np.sign(last) * step
    own, pre, post, stem, moves = (x.copy() for x in np.split(weights, at[1:-1]))
    p, _, _ = marginals()
    x, w = _sums(p, lengths), np.zeros(4)
    counts = np.where(y == 1, prior / own_share, (1 - prior) / (1 - own_share))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * q * (1 - q))[:, None]).T @ x + 0.5 * np.diag([0.01, 1, 1, 1])
        move = np.linalg.solve(h, x.T @ (counts * (y - q)) - 0.5 * np.array([0.01, 1, 1, 1]) * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return Model(vocabulary, stems, stem_of, own, stem, pre, post, moves.reshape(2, 2), w, prior)


def tag(model: Model, texts: list[str]) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """Per text: its score and the toxic spans (first and end character, mean marginal) where marginals reach one half."""
    if not model.vocabulary:
        return [(model.prior, [])] * len(texts)
    raw = [t.encode() for t in texts]
    plain = [r.translate(_BLANK) for r in raw]
    cut = [p.split() for p in plain]
    lengths = np.array([len(c) for c in cut], np.int64)
    ids, parts = _features(model.vocabulary, model.stems, model.stem_of, cut)
    before, after = _shifted(ids, lengths)
    p, _, _ = Chains(lengths).marginals(model.own[ids] + model.stem[parts] + model.before[before] + model.after[after], model.moves)
    scores = 1 / (1 + np.exp(-np.clip(_sums(p, lengths) @ model.document, -30, 30)))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    starts, hot = np.cumsum(lengths) - lengths, np.flatnonzero(p >= 0.5)
    cuts = np.searchsorted(hot, np.append(starts, len(p)))
    for d in np.flatnonzero(np.diff(cuts)).tolist():
        spans[d] = _spans(raw[d], plain[d], hot[cuts[d] : cuts[d + 1]] - starts[d], p[starts[d] : starts[d] + lengths[d]])
    return list(zip(scores.tolist(), spans))


def _spans(raw: bytes, plain: bytes, hot: np.ndarray, p: np.ndarray) -> list[tuple[int, int, float]]:
    """First and end character and mean marginal of each stretch of hot words of one text, in time linear in the text."""
    at = np.array([m.span() for m in _WORD.finditer(plain)], np.int64)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
    breaks = np.flatnonzero(np.diff(hot) > 1)
    first, last = hot[np.concatenate([[0], breaks + 1])], hot[np.append(breaks, len(hot) - 1)]
    means = np.add.reduceat(p[hot], np.concatenate([[0], breaks + 1])) / (last - first + 1)
    return list(zip(before[at[first, 0]].tolist(), before[at[last, 1]].tolist(), means.tolist()))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 1500, most_bytes: int = 10 << 20) -> Model:
    """A model from a sample of the labelled documents whose fold is not 0: of each label up to per_class ids by hash and half of most_bytes of whole texts.

    Ids are chosen by their sizes before texts move. One that does not fit in what is left of its label's bytes is passed
    over alone, and those over a sixteenth of the bytes come after all others. One task takes the sample, which most_bytes
    bounds, and fits; ids, sizes and the model are all that reaches the driver, with the share of toxic documents among
    all that could be chosen, so that the make-up of the sample does not shift scores. A document with several labels
    counts as toxic if one says so; null labels and ids count as none.
    """
    spark, share = docs.sparkSession, most_bytes // 2
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(id_remainder(folds) != 0)
    sizes = docs.filter(F.col("doc_id").isNotNull() & (id_remainder(folds) != 0)).groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    sizes = written(sizes.filter(F.col("size") <= share).join(known, "doc_id"), "sizes")
    marked = sizes.agg(F.avg("toxic")).first()[0] or 0.0
    some = [sizes.filter(F.col("toxic") == k).orderBy(F.col("size") > share // 16, F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    left, chosen = {0: share, 1: share}, []
    for r in some[0].unionByName(some[1]).collect():
        if r["size"] <= left[r.toxic]:
            left[r.toxic] -= r["size"]
            chosen.append((r.doc_id, r.toxic))
    ids = spark.createDataFrame(chosen, sizes.select("doc_id", "toxic").schema)
    small_arrow_batches(spark)
    text = F.coalesce("text", F.lit("")).alias("text")
    sample = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("at"), "doc_id", "text", "toxic").repartition(1)

    def run(batches):
        got = sorted(text_rows(batches, "at", "doc_id", "text", "toxic"))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit([r[2] for r in got], [r[3] for r in got], share=marked))], pa.binary())})

    row = sample.mapInArrow(lambda batches: released(run(batches)), "model binary").first()
    return pickle.loads(row.model) if row else fit([], [], share=marked)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """docs (their columns, or `keep`) with score and spans (first, end, marginal), under `names`. Null and empty texts get the score of no words.

    Columns of docs that have these names are replaced. A very long text is tagged whole by one task, in time and memory
    in proportion to it. Repeated rows and null ids are rows like others, equal texts get equal scores, an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*keep, *([text] if text not in keep else []))
    shape = "array<struct<first: int, end: int, marginal: double>>"
    schema = docs.select(*keep, F.lit(0.0).alias(names[0]), F.array().cast(shape).alias(names[1])).schema
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        for batch in batches:
            lo = 0
            for part in by_size(((t or "",) for (t,) in text_rows([batch], text)), 1 << 20):
                got = tag(shared.value, [t for (t,) in part])
                own = batch.slice(lo, len(part))
                lo += len(part)
                new = [pa.array([s for s, _ in got], pa.float64()), pa.array([[dict(zip(("first", "end", "marginal"), x)) for x in spans] for _, spans in got], span)]
                yield pa.RecordBatch.from_arrays([own.column(own.schema.get_field_index(c)) for c in keep] + new, names=[*keep, *names])

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out (fold 0 of five), score, predicted (score of one half or more), n_spans, by a tagger that learns from the other folds; see learn() and score() for nulls, long texts, ties, repeats and empty tables."""
    scored = score(docs, learn(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"))
