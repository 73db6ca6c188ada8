"""SimHash fingerprints of word shingles, linked by fuzzy hashing with the binary Golay code; near copies by such links and the likeness of their shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, released, small_arrow_batches, text_rows, written
from .components import components

#: Fixed value: generator polynomial of the binary (23, 12) Golay code.
GOLAY = 0b101011100011
#: Start and width of the three segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 15
#: Bands of MinHash values and values in a band: two texts of likeness 0.8 share no band with a chance of (1 - 0.8^5)^60 < 1e-10.
BANDS, ROWS = 60, 5
#: Fingerprints of a set of shingles, and bits of all of them in which two texts of likeness 0.8 may differ (39 on average, deviation 6; unlike ones 128).
PRINTS, MOST_BITS = 4, 80


def _shingles(text: str | None, words: int) -> Iterator[bytes]:
    """Each `words` words in a row, in lower case; a shorter text is one shingle, one without words has none."""
    parts = (text or "").encode().lower().split()
    if len(parts) >= words:
        return map(b" ".join, zip(*(parts[i:] for i in range(words))))
    return iter([b" ".join(parts)] if parts else [])


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text: a bit is set if over half of the shingles' hashes have it. No words: 0."""
    shingles = _shingles(text, words)
    total, n = np.zeros(64, np.int64), 0
    while True:
        hashes = np.fromiter((h for _, h in zip(range(_CHUNK), map(xxhash.xxh64_intdigest, shingles, repeat(42)))), np.uint64)
        if not len(hashes):
            break
        n += len(hashes)
        total += _votes(hashes)
    if not n:
        return 0
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


@cache
def codewords() -> tuple[np.ndarray, np.ndarray]:
    """nearest: for each 11-bit syndrome the error pattern of at most three bits; syndrome of each of the 23 positions."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    bits = np.array([remainder(1 << k) for k in range(23)])
    nearest = np.zeros(2048, np.int64)
    for weight in range(4):
        for at in combinations(range(23), weight):
            s = 0
            for k in at:
                s ^= int(bits[k])
            nearest[s] = sum(1 << k for k in at)
    return nearest, bits


@cache
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the patterns that lead to the nearby codewords, and how many.

    The nearest codeword always; if it is three bits away, also the five at distance four, which hold those three bits.
    Two 23-bit words that differ in at most two bits then share at least one codeword.
    """
    nearest, bits = codewords()
    syndromes: dict[int, list[int]] = {}
    for at in combinations(range(23), 4):
        s = int(bits[at[0]] ^ bits[at[1]] ^ bits[at[2]] ^ bits[at[3]])
        syndromes.setdefault(s, []).append(sum(1 << k for k in at))
    patterns, count = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    patterns[:, 0] = nearest
    for s in range(2048):
        if int(nearest[s]).bit_count() == 3:
            far = [p for p in syndromes[s]]
            patterns[s, 1 : 1 + len(far)] = far
            count[s] = 1 + len(far)
    return patterns, count


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for k, s in enumerate(codewords()[1]):
        out ^= (words >> k & 1) * int(s)
    return out


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index of the fingerprint, key) for unsigned 64-bit fingerprints.

    Of two fingerprints that differ in at most two bits, one of three segments is equal; the one after it differs in at
    most two bits and shares a codeword. A key holds the number and bits of the first and the codeword's 12-bit index.
    """
    patterns, count = golay_keys()
    rows, keys = [], []
    parts = [(prints >> np.uint64(lo) & np.uint64((1 << width) - 1)).astype(np.int64) for lo, width in SEGMENTS]
    for i in range(3):
        word = parts[(i + 1) % 3]
        s = _syndrome(word)
        for j in range(6):
            own = np.flatnonzero(count[s] > j)
            index = (word[own] ^ patterns[s[own], j]) >> 11
            rows.append(own)
            keys.append((np.int64(i) << 40) | (parts[i][own] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """docs without the text, with `fp`, the fingerprint as a signed long."""
    small_arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            got = [fingerprint(t, words) for (t,) in text_rows([batch], text)]
            column = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [column], names=[*kept, "fp"])

    return docs.select(*kept, text).mapInArrow(lambda batches: released(run(batches)), schema)


def links(prints: DataFrame, most: int = 64) -> DataFrame:
    """Rows (a, b) of distinct signed fingerprints `fp` that link all that differ in at most two bits.

    Groups under one key of up to `most` fingerprints are compared with one another. Larger ones take an exact path
    whose groups are bounded: two fingerprints differ in at most two bits if both are within one bit of some word, and
    such a group has 65 members at most, which are all linked to its smallest.
    """

    def keyed(batches):
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 1 << 14):
                part = fps[lo : lo + (1 << 14)]
                rows, keys = segment_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], schema=schema)

    def flipped(batches):
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 1 << 12):
                part = fps[lo : lo + (1 << 12)]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], schema=schema)

    def compared(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def pairs():
            for (group,) in text_rows(batches, "fps"):
                fps = np.unique(np.array(group, np.int64))
                near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 2
                for i, j in np.argwhere(np.triu(near, 1)).tolist():
                    yield int(fps[j]), int(fps[i])

        yield from in_batches(pairs(), schema, 4096)

    keys = prints.select("fp").mapInArrow(keyed, "key long, fp long")
    counted = keys.withColumn("n", F.expr("count(*) over (partition by key)")).filter("n > 1")
    counted = written(counted, "keys")
    small = counted.filter(F.col("n") <= most).groupBy("key").agg(F.collect_list("fp").alias("fps")).mapInArrow(compared, "a long, b long")
    near = counted.filter(F.col("n") > most).select("fp").distinct().mapInArrow(flipped, "key long, fp long")
    stars = near.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return small.unionByName(stars).distinct()


def linked_prints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fp (signed long), component_id: the smallest doc_id that links of at most two bits lead to, itself included.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay rows of one component.
    A null doc_id is the smallest of nothing: its row gets the component of its fingerprint. Other columns do not matter.
    """
    base = written(with_fingerprint(docs.select("doc_id", F.col(text).alias("text")), "text", words), "fingerprints")
    least = written(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    return _with_components(base, least, components(links(least.select("fp"))), "fp").select("doc_id", "fp", "component_id")


def _with_components(base: DataFrame, least: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """base with component_id: over the nodes of one root, the least of `least` (node, least); a node without links is its own root."""
    members = roots.join(least, roots["node"] == least[node]).select(roots["node"].alias("member"), "root", "least")
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(members.select("member", "root").join(smallest, "root").select(F.col("member").alias(node), "component_id"), "named")
    all_named = least.join(named, node, "left").select(node, F.coalesce("component_id", "least").alias("component_id"))
    return base.join(all_named, node)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _shingles(text, words), repeat(42)), np.uint64))


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of a band's number and its ROWS MinHash values; none for no shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 512):
        least = np.minimum(least, (_factors()[:, None] * shingles[None, lo : lo + 512]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def set_prints(shingles: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a set of shingles by the rule of fingerprint(), the first of the hashes as they are, the others of mixed ones; none for no shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    total = np.zeros((PRINTS, 64), np.int64)
    for lo in range(0, len(shingles), _CHUNK):
        part = shingles[lo : lo + _CHUNK]
        total[0] += _votes(part)
        for j in range(1, PRINTS):
            mixed = (part ^ np.uint64(j)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            total[j] += _votes(mixed ^ mixed >> np.uint64(32))
    return np.packbits(2 * total > len(shingles), axis=1, bitorder="little").view(np.uint64)[:, 0]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A column of lists of signed longs."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def with_bands(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs (doc_id, text) with `node`, a signed long that names the text's set of shingles, `keys`, its band keys, and `prints`, its fingerprints."""
    small_arrow_batches(docs.sparkSession)
    longs = F.array().cast("array<long>")
    schema = docs.select("doc_id", "text", F.lit(0).cast("long").alias("node"), longs.alias("keys"), longs.alias("prints")).schema

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for (t,) in text_rows([batch], "text")]
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64))
            new = [nodes, _lists([band_keys(s) for s in sets]), _lists([set_prints(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")] + new, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), schema)


def with_sets(texts: DataFrame, words: int = 5) -> DataFrame:
    """texts (node, text, ...) with `size`, the number of distinct shingles, and `shingles`, their ascending hashes as bytes, in place of the text."""
    small_arrow_batches(texts.sparkSession)
    kept = [c for c in texts.columns if c != "text"]
    schema = texts.select(*kept, F.lit(0).alias("size"), F.lit(b"").alias("shingles")).schema

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for (t,) in text_rows([batch], "text")]
            new = [pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + new, names=[*kept, "size", "shingles"])

    return texts.mapInArrow(lambda batches: released(run(batches)), schema)


def measured(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """pairs (a, b, least) of nodes of with_sets(): a, b, their sizes x and y, `common` shingles, `alike` by Jaccard, and `fresh`.

    `fresh` are shingles of a that b lacks, in ascending order and as many as a prefix filter needs: a text of `least` or
    more shingles that is alike to a and shares some shingle with it that b lacks shares one of these.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("common", pa.int32()), ("alike", pa.bool_()), ("fresh", pa.list_(pa.int64()))])

    def rows(batches):
        read = lru_cache(64)(lambda raw: np.frombuffer(raw, np.uint64))
        for a, b, least, s, t in text_rows(batches, "a", "b", "least", "s", "t"):
            x, y = read(s), read(t)
            own = np.setdiff1d(x, y, assume_unique=True)
            common = len(x) - len(own)
            shared = math.ceil(similarity / (1 + similarity) * (len(x) + max(least, similarity * len(x))) - 1e-6)
            yield a, b, len(x), len(y), common, common >= similarity * (len(x) + len(y) - common) - 1e-9, own[: max(0, len(x) - shared + 1)].view(np.int64)

    small_arrow_batches(pairs.sparkSession)
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "least", "s", "t")
    return both.mapInArrow(lambda batches: released(in_batches(rows(batches), schema, 4096, weigh=lambda row: 48 + row[-1].nbytes)), "a long, b long, x int, y int, common int, alike boolean, fresh array<long>")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (a, b) of nodes: the smallest root that they lead to."""
    one, two = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    edges = written(links.join(one, "a").join(two, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return roots
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def _still_apart(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """groups (key, node, ...) with root and n, the members, of those keys whose members have several roots."""
    own = groups.drop("root", "n").join(roots, "node")
    mixed = own.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "n")
    return written(own.join(mixed, "key"), "apart")


def _pairs_within(groups: DataFrame, similarity: float, small: int) -> DataFrame:
    """Pairs (a, b) of members of different roots and near enough sizes of the groups; those of up to `small` that have the same members count once."""
    lists = groups.filter(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "root", "size"))).alias("own")).groupBy("own").agg(F.min("key").alias("key"))
    flat = lists.select("key", F.explode("own").alias("x")).select("key", "x.*").unionByName(groups.filter(F.col("n") > small).select("key", "node", "root", "size"))
    other = flat.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"))
    near = (F.least("size", "sb") >= similarity * F.greatest("size", "sb")) & (F.col("root") != F.col("rb")) & (F.col("node") > F.col("b"))
    return flat.join(other, "key").filter(near).select(F.col("node").alias("a"), "b").distinct()


def _near_one(held: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Of measured() rows, the pairs of nodes that may be alike though all that they share is in the same b: both need enough of it."""
    bound = (1 + similarity) / similarity
    near = held.filter(F.col("common") >= similarity * F.col("x") - 1e-9).withColumn("cap", F.col("common") * bound - F.col("x") + 1e-6)
    least = near.groupBy("b").agg(F.min("x").alias("lo"))
    one = near.filter("not alike").join(least, "b").filter("cap >= lo").join(roots.withColumnRenamed("node", "a"), "a")
    two = near.select("b", F.col("a").alias("c"), F.col("x").alias("z"), F.col("cap").alias("cap2")).join(roots.select(F.col("node").alias("c"), F.col("root").alias("root2")), "c")
    met = one.join(two, "b").filter((F.col("z") <= F.col("cap")) & (F.col("x") <= F.col("cap2")) & (F.col("root") != F.col("root2")))
    return met.select(F.greatest("a", "c").alias("a"), F.least("a", "c").alias("b")).distinct()


def golay_groups(base: DataFrame) -> DataFrame:
    """Rows (key, node) of with_bands() rows: each node under the keys of its fingerprints (segment_keys(), by number of the fingerprint); keys of one node alone are left out."""

    def keyed(batches):
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
        for batch in batches:
            nodes, prints = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
            for j in range(PRINTS):
                rows, keys = segment_keys(prints[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(keys | np.int64(j) << 44), pa.array(nodes[rows])], schema=schema)

    once = base.filter(F.size("prints") > 0).select("node", "prints").dropDuplicates(["node"])
    keys = once.mapInArrow(keyed, "key long, node long")
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose fingerprints are near and whose whole sets of shingles are alike."""
    one, two = sets.select(F.col("node").alias("a"), F.col("prints").alias("p")), sets.select(F.col("node").alias("b"), F.col("prints").alias("q"))
    bits = sum((F.bit_count(F.col("p")[j].bitwiseXOR(F.col("q")[j])) for j in range(PRINTS)), F.lit(0))
    near = pairs.join(one, "a").join(two, "b").filter(bits <= MOST_BITS).select("a", "b", F.lit(1 << 30).alias("least"))
    return measured(near, sets, similarity).filter("alike").select("a", "b")


def print_links(groups: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, small: int) -> DataFrame:
    """roots after links by fingerprints: rows (key, node, weight, size) of golay_groups() are held against one leader of their key, those of up to `small` that are still apart against each other."""
    lead = groups.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("b"))
    roots = _merged(roots, _alike(groups.join(lead, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), sets, similarity))
    apart = _still_apart(groups, roots).filter(F.col("n") <= small)
    return _merged(roots, _alike(_pairs_within(apart, similarity, small), sets, similarity))


def near_links(base: DataFrame, words: int = 5, similarity: float = 0.8, small: int = 32, rounds: int = 8, few: int = 8) -> DataFrame:
    """(node, root) of the components of all pairs of nodes that share a band and are alike, for rows of with_bands().

    Fingerprints come first: texts that share a segment and a Golay codeword of one are compared by print_links(). That
    reaches most near copies, but not all at a likeness near 0.8; the bands are the exact way for the rest, so only groups
    of a band whose members are still apart go on.

    A large group of near copies is never compared pair by pair. Its members are held against one leader, the member that
    meets most others. Two texts that are alike are then both alike to the leader, or share a shingle that the leader
    lacks, or all that they share is the leader's, which needs much of it in both. So what is still apart meets again by
    leader and shingle, in smaller groups with leaders of their own, and groups of up to `small` members are compared
    whole. Leaders fall in a fixed order from one such round to the next, so this ends. When what is left makes no more
    than `few` pairs for each node, or after `rounds`, it is compared whole.
    """
    keys = base.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    groups = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "groups")
    coded = written(golay_groups(base), "golay")
    weights = groups.select("node", "n").unionByName(coded.select("node", F.lit(0).cast("long").alias("n"))).groupBy("node").agg(F.sum("n").alias("weight"))
    texts = base.select("node", "text", "prints").join(weights, "node").dropDuplicates(["node"])
    sets = written(with_sets(texts, words), "sets")
    brief = sets.select("node", "weight", "size")
    nodes, last = brief.count(), False
    roots = print_links(coded.join(brief, "node"), sets.select("node", F.col("node").alias("root")), sets, similarity, small)
    groups = _still_apart(groups.select("key", "node").join(brief, "node"), roots).select("key", "node", "weight", "size")
    for turn in range(rounds + 1):
        lead = groups.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("leader"), F.min("size").alias("least"))
        if turn == 1:  # the same groups again: leaders that are linked give way to the foremost of them
            hubs = brief.join(roots, "node").groupBy("root").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
            lead = lead.join(roots.withColumnRenamed("node", "leader"), "leader").join(hubs, "root").select("key", F.col("hub").alias("leader"), "least")
        led = written(groups.select("key", "node").join(lead, "key"), "led")
        pairs = led.filter("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.min("least").alias("least"))
        held = written(measured(pairs, sets, similarity), "held")
        roots = _merged(roots, held.filter("alike").select("a", "b"))
        apart = _still_apart(groups, roots)
        whole = apart if last else apart.filter(F.col("n") <= small)
        met, large = _pairs_within(whole, similarity, small), apart.filter(F.col("n") > small)
        if turn:
            large_led = led.join(large.select("key").distinct(), "key", "left_semi").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
            held = written(held.join(large_led, ["a", "b"]), "held")
            met = met.unionByName(_near_one(held, roots, similarity)).distinct()
        roots = _merged(roots, measured(met.withColumn("least", F.lit(1 << 30)), sets, similarity).filter("alike").select("a", "b"))
        if last:
            break
        if not turn:
            groups = written(large.select("key", "node", "weight", "size"), "groups")
        else:
            fresh = held.select(F.col("a").alias("node"), "b", F.explode("fresh").alias("t")).select("node", F.xxhash64("b", "t").alias("key"))
            more = fresh.join(fresh.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key").join(brief, "node")
            groups = _still_apart(more, roots).select("key", "node", "weight", "size")
        left = groups.groupBy("key").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0]
        if not left:
            break
        last = turn + 1 >= rounds or turn > 0 and left <= few * nodes
    return roots


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id, text_md5 (bytes, of the text; null: the empty one), component_id: the smallest doc_id that near copies lead to, itself included, and `component`, a name of the component.

    Near copies are texts whose sets of shingles have a Jaccard likeness of `similarity` or more; candidates come from
    SimHash fingerprints of the sets by Golay codewords, then, for what these leave apart, from bands of MinHash values;
    each is checked on the whole sets. Texts without words are one component. A null doc_id is
    the smallest of nothing; a doc_id with several texts is in the component of each. Repeated rows stay rows of one
    component, very long texts are taken whole, an empty table gives no rows. Other columns do not matter. Below 0.8 the
    bands miss more.
    """
    base = written(with_bands(docs.select("doc_id", F.col(text).alias("text")), words), "bands")
    least = written(base.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    roots = near_links(base, words, similarity)
    rows = base.select("doc_id", "node", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_md5"))
    named = rows.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    return _with_components(named, least, roots, "node").select("doc_id", "text_md5", "component", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    found = linked_prints(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
