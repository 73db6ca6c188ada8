"""Periodic runs of words: stretches that repeat themselves at least three times, found by minimizers at several scales."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, released, small_arrow_batches, text_rows

#: A run has LEAST words or more and TIMES periods or more.
LEAST, TIMES = 24, 3
#: Periods up to SHORT are scanned lag by lag; grams of SHORT words must repeat for any longer one.
SHORT = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: long, length: long, period: long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in a fixed order that has nothing to do with their own."""
    x = x.astype(np.uint64) * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _slide(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over every window of `width` items, by doubling."""
    size = 1
    while 2 * size <= width:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def minimizers(order: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window of `width` values in a row; all of them where several tie."""
    least = _slide(np.minimum, order, width)
    edge = np.zeros(width - 1, order.dtype)
    return np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), width) == order)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items of two arrays are equal; reads little more than that."""
    done, step, n = 0, 64, min(len(a), len(b))
    while done < n:
        differs = a[done : min(done + step, n)] != b[done : min(done + step, n)]
        at = int(differs.argmax())
        if differs[at]:
            return done + at
        done, step = done + step, 2 * step
    return n


def _lag_scan(ids: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of period q that are long enough, by comparing each word with that q words on."""
    need = max(LEAST, TIMES * q) - q
    same = ids[:-q] == ids[q:]
    if np.count_nonzero(same) < need:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= need
    return [(a, b - a + q) for a, b in zip(starts[long].tolist(), ends[long].tolist())]


def _ranks(ids: np.ndarray, size: int, by: int) -> np.ndarray:
    """Numbers of grams of size + by words from those of `size` words: equal if and only if the words are."""
    return np.unique(ids[:-by] * np.int64(len(ids) + by + 1) + ids[by:], return_inverse=True)[1]


def _repeats(ids: np.ndarray) -> bool:
    """Whether some gram of SHORT words may stand at two places; never false where one does."""
    h, size = _mixed(ids), 1
    while size < SHORT:
        h, size = _mixed(h[:-size] * np.uint64(3) + h[size:]), 2 * size
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _seeds(ids: np.ndarray):
    """(place, period) pairs, period > SHORT, among them one or more in each run of such a period.

    A scale takes periods lo to P = 4/3 lo. In a run of such a smallest period q, of 3 q words or more, grams of P words
    are equal at places q apart and at no nearer ones. Windows of 2 lo - P + 1 grams fit in it at two places q apart, have
    the same least gram there, and so give neighbouring equal minimizers at distance q.
    """
    n, lo = len(ids), SHORT + 1
    ranks, size = np.unique(ids, return_inverse=True)[1], 1
    while lo <= n // TIMES:
        k = lo * 4 // 3
        while 2 * size <= k:
            ranks, size = _ranks(ranks, size, size), 2 * size
            if len(ranks) == 0 or int(ranks.max()) + 1 == len(ranks):
                return
        m = n - k + 1
        gram = ranks[:m] * np.int64(len(ranks) + 1) + ranks[k - size : k - size + m]
        at = minimizers(_mixed(gram), 2 * lo - k + 1)
        order = np.argsort(gram[at], kind="stable")
        own, place = gram[at][order], at[order]
        lag = place[1:] - place[:-1]
        good = (own[1:] == own[:-1]) & (lag >= lo) & (lag <= k)
        found, lags = place[:-1][good], lag[good]
        by_lag = np.lexsort((found, lags))
        yield from zip(found[by_lag].tolist(), lags[by_lag].tolist())
        lo = k + 1


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of an array of word numbers, by start and period; work grows as n log n.

    A run is a stretch with smallest period q and max(LEAST, TIMES q) words or more that no neighbour extends.
    """
    n, found = len(ids), {}
    if n < LEAST:
        return []
    for q in range(1, min(SHORT, n // TIMES) + 1):
        for stretch in _lag_scan(ids, q):
            found.setdefault(stretch, q)
    if n > TIMES * SHORT and _repeats(ids):
        back, seen = ids[::-1], (0, 0)
        for p, q in _seeds(ids):
            if q == seen[0] and p < seen[1]:
                continue
            ahead, behind = _equal(ids[p:], ids[p + q :]), _equal(back[n - p :], back[n - p - q :])
            seen = (q, p + ahead)
            if ahead + behind + q >= max(LEAST, TIMES * q):
                stretch = (p - behind, ahead + behind + q)
                found[stretch] = min(q, found.get(stretch, q))
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the distinct words; a very long text is cut word by word."""
    seen: dict[bytes, int] = defaultdict(count().__next__)
    words = text.split() if len(text) < 1 << 22 else (m[0] for m in _WORD.finditer(text))
    ids = np.fromiter(map(seen.__getitem__, words), np.int64)
    return ids, list(seen)


def collapsed(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if runs:
        edge = np.zeros(len(ids) + 1, np.int64)
        for start, length, q in runs:
            edge[start + q] += 1
            edge[start + length] -= 1
        ids = ids[np.cumsum(edge[:-1]) == 0]
    return b" ".join(map(words.__getitem__, ids.tolist()))


def with_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns, or `keep`) with n_words, runs (start, length, period: by start, then period) and collapsed, the text without repeats.

    Words are what stands between blanks (U+0020, U+0009 to U+000D). Null and empty texts have no words, no runs and an
    empty collapsed text. A very long text is taken whole by one task, with memory for some numbers a word. Stretches of
    equal start and length have one period, the smallest. Repeated rows and null ids are rows like others, an empty table
    gives an empty one; columns of docs with the new names are replaced.
    """
    new = ("n_words", "runs", "collapsed")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_run_text"))
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            own = batch.select(keep) if keep else None
            out, lo = [], 0
            shape = pa.schema([("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

            def rows():
                for (t,) in text_rows([batch], "_run_text"):
                    ids, words = numbered(t)
                    runs = find_runs(ids)
                    yield len(ids), [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed(ids, words, runs).decode()

            for out in in_batches(rows(), shape, weigh=lambda r: len(r[2])):
                part = own.slice(lo, out.num_rows) if own is not None else None
                lo += out.num_rows
                yield pa.RecordBatch.from_arrays([*(part.columns if part is not None else []), *out.columns], names=[*keep, *new])

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def cycled(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """A text for tests of repeats: of documents whose h = crc32(decimal id) divides by 10, the words from a on go round in a cycle of p words; other texts as they are.

    g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) for n words. A null id has no h; null texts and
    those without words stay.
    """
    h = f"crc32(cast(cast({doc_id} as string) as binary))"
    words = rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    turned = "transform(x.w, (v, i) -> x.w[cast(if(i < x.a, i, x.a + (i - x.a) % x.p) as int)])"
    struct = f"transform(array({words}), w -> struct(w, size(w) as n, {h} div 10 as g))"
    struct = f"transform({struct}, x -> struct(x.w, x.n, x.g, x.g % x.n as a))"
    struct = f"transform({struct}, x -> struct(x.w, x.a, 1 + (x.n - x.a) div (3 + x.g % 8) as p))[0]"
    again = f"transform(array({struct}), x -> array_join({turned}, ' '))[0]"
    return F.expr(rf"case when {h} % 10 = 0 and {text} rlike '[^\\x20\\x09-\\x0D]' then {again} else {text} end")


def op11_periods(docs: DataFrame) -> DataFrame:
    """Per row of docs, whose text is first cycled(): doc_id, n_runs, the run of most periods (ties: smallest start, then period; none: nulls) and digests of all runs and of the collapsed text. See with_runs() for the rest."""
    found = with_runs(docs.select("doc_id", cycled().alias("text")), keep=["doc_id"])
    best = "aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))"
    line = "concat(r.start, ',', r.length, ',', r.period, '\\n')"
    got = found.select("doc_id", "n_words", "runs", "collapsed", F.expr(best).alias("best"))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.expr(f"array_join(transform(runs, r -> {line}), '')").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
