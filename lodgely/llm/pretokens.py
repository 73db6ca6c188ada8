"""Token ids of whole texts from ids of their pieces: Arrow cuts texts and numbers the pieces, numpy gathers the ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A blank that no white space follows starts a new pre-token, whatever stands before it.
_START = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    places = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    places += np.repeat(starts - (ends - lengths), lengths)
    return values[places]


class Memory:
    """Ids of pieces, as runs of one array. When there are more than `most` pieces, all are forgotten."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.values, self.used = np.zeros(1 << 14, np.int32), 0

    def _put(self, new: list[str]) -> None:
        values, lengths = self.encode(new)
        n, most = len(self.place), self.used + len(values)
        if n + len(new) > len(self.starts):
            size = 2 * (n + len(new))
            self.starts, self.lengths = np.resize(self.starts, size), np.resize(self.lengths, size)
        if most > len(self.values):
            self.values = np.resize(self.values, 2 * most)
        self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(new)] = lengths
        self.values[self.used : most] = values
        self.used = most
        self.place.update(zip(new, range(n, n + len(new))))

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, in `values`, of the ids of each piece."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.place) > self.most:
            self.forget()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.place) + np.arange(len(new))
            self._put([names[k] for k in new.tolist()])
        at = at[coded.indices.to_numpy()]
        return self.starts[at], self.lengths[at]


class Named(Memory):
    """A memory that can be asked for lists of strings too, and takes those of Arrow by way of numpy."""

    def __call__(self, pieces: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(pieces, pa.Array):
            coded = pieces.dictionary_encode()
            starts, lengths = self(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            at = coded.indices.to_numpy()
            return starts[at], lengths[at]
        if len(self.place) > self.most:
            self.forget()
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            new = [pieces[k] for k in lost.tolist()]
            apart, n = list(dict.fromkeys(new)), len(self.place)
            self._put(apart)
            at[lost] = n + np.arange(len(new)) if len(apart) == len(new) else np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        return self.starts[at], self.lengths[at]


class Remembered:
    """Encodes texts by pieces: what stands before the first blank that starts a pre-token, and each such blank with what follows.

    `encode` gives the ids of a list of whole pieces, one after the other, and how many each has. Pieces are remembered,
    about `most` of them, after which all are forgotten, so memory does not grow with the number of texts.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 800_000, kind: type[Memory] = Memory):
        self.first = kind(encode, most // 4)
        self.later = kind(lambda pieces: encode([" " + p for p in pieces]), most)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        if odd := [k for k, t in enumerate(texts) if _ODD.search(t)]:
            places = np.arange(len(texts))
            places[odd] = len(texts) + np.arange(len(odd))
            cut = pa.concat_arrays([cut, pa.array([_START.split(texts[k]) for k in odd], cut.type)]).take(pa.array(places))
        count = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = pc.list_flatten(cut)
        head = np.zeros(len(pieces), bool)
        begin = np.cumsum(count) - count
        head[begin] = True
        heads = self.first(pieces.take(pa.array(begin)))
        tails = self.later(pieces.filter(pa.array(~head)))
        starts, lengths = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        starts[head], lengths[head] = heads[0], heads[1]
        starts[~head], lengths[~head] = tails[0] + self.first.used, tails[1]
        ids = gathered(np.concatenate([self.first.values[: self.first.used], self.later.values[: self.later.used]]), starts, lengths)
        return ids, np.add.reduceat(lengths, begin) if len(begin) else np.zeros(0, np.int64)


def by_pattern(pattern: str, encode: Callable[[list[str]], Iterable[list[int]]], most: int = 100_000) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes pieces by their pre-tokens, the matches of a pattern, each of which is encoded by itself and remembered."""
    find = regex.compile(pattern).findall

    def whole(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = encode(tokens)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((k for ids in got for k in ids), np.int32, int(lengths.sum())), lengths

    known = Memory(whole, most)

    def pieces_to_ids(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [find(p) for p in pieces]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = [t for c in cut for t in c]
        if not flat:
            return np.zeros(0, np.int32), count
        starts, lengths = known(pa.array(flat, pa.string()))
        owner = np.repeat(np.arange(len(cut)), count)
        return gathered(known.values, starts, lengths), np.bincount(owner, lengths, len(cut)).astype(np.int64)

    return pieces_to_ids


def by_size(texts: Iterable[tuple], most: int = 1 << 21):
    """Lists of rows whose texts (the last value) have about `most` characters together, or a single longer one."""
    held, size = [], 0
    for row in texts:
        if held and size + len(row[-1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held
