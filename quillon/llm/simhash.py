"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits, read as words
of the binary Golay code (23, 12), in which each word is within 3 bits of one
codeword. Two words at most 1 bit apart share a codeword index: the index of
either is among the indices (1 or 6 as a rule) of the other and its neighbours.
Three errors over three segments leave either one segment without error and
another with one at most, or one error in each; so seven kinds of keys, each of
33 bits or more, bring together every pair of fingerprints at 3 bits or fewer.
One side gives its own indices, the other side's neighbourhood meets them, and
each pair that meets is verified.

``components`` links fingerprints at ``3`` bits or fewer. ``near_duplicates``
is for shingle similarity, which fingerprints cannot decide alone: texts that
meet by their fingerprints are candidates, and so are those that share a rare
shingle, which makes it exact up to
64-bit hash collisions: in any one order of all shingles, two sets at a
similarity of t have one in common among the first n - ceil(t n) + 1 of each, so
these are keys. The order has shingles that are frequent in a sample last, so
few keys are crowded; which they are changes work, never results. Under a key
of few texts all pairs are candidates; under others each text first meets one
hub, and keys whose texts are in several groups still are searched whole in
pairs of blocks. Parity bitmaps, a few dozen bytes a text, exclude most
candidates without a doubt; the others are verified on the shingle sets.

Defined results: a null or wordless text has the fingerprint zero and is linked
as any other; null ids never are a component's id unless it has no other;
repeated rows are in one component; empty tables give empty results; other
columns pass through ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, materialize, named, worker_cache
from .components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: More left rows than this under one key: their links are found by search in blocks, without all pairs.
HOT, BLOCK = 512, 8192
#: Under a key of this many texts at most, all pairs are candidates; larger ones are linked through hubs, then searched in blocks.
FEW = 16
#: Shingles a block holds when a crowded key is searched, a text counting as TEXT shingles more; columns multiplied at once.
TILE, TEXT, COLUMNS = 400_000, 200, 4096
#: Texts whose shingles are counted to order them by frequency, and how many frequent ones are told to the workers.
COUNTED, FREQUENT = 6000, 200_000


class Golay:
    """Codeword index of 23-bit words, by syndrome."""

    GENERATOR = 0b110001110101

    def __init__(self):
        def rest(v: int) -> int:
            for k in range(22, 10, -1):
                if v >> k & 1:
                    v ^= self.GENERATOR << (k - 11)
            return v

        one = [rest(1 << k) for k in range(23)]
        table = lambda bits: np.array([np.bitwise_xor.reduce([b for k, b in enumerate(bits) if v >> k & 1] or [0]) for v in range(1 << len(bits))], np.int32)
        self.low, self.high = table(one[:12]), table(one[12:])
        self.error = np.zeros(1 << 11, np.int32)
        for n in range(1, 4):
            for places in combinations(range(23), n):
                v = sum(1 << k for k in places)
                self.error[rest(v)] = v

    def index(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.low[v & 4095] ^ self.high[v >> 12]]) >> 11

    def near(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of each word and of all words 1 bit away within ``width``: a row each, and which entries count."""
        flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int32)]).astype(np.int32)
        found = np.sort(self.index(v[:, None] ^ flips), axis=1)
        new = np.concatenate([np.ones((len(v), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        most = int(new.sum(1).max(initial=1))
        order = np.argsort(~new, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(found, order, 1), np.take_along_axis(new, order, 1)


def golay() -> Golay:
    return worker_cache("golay", Golay)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int32) for s, w in SEGMENTS]


def left_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) rows of the side that gives its own indices."""
    g, seg = golay(), segments(fp)
    own = [g.index(s).astype(np.int64) for s in seg]
    n, rows, keys = np.arange(len(fp)), [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        rows.append(n)
        keys.append((tag << 40) | (seg[i].astype(np.int64) << 12) | own[j])
    near, real = g.near(seg[0], SEGMENTS[0][1])
    r, c = np.nonzero(real)
    rows.append(r)
    keys.append((6 << 40) | (near[r, c].astype(np.int64) << 24) | (own[1][r] << 12) | own[2][r])
    return np.concatenate(rows), np.concatenate(keys)


def right_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) rows of the side that gives its neighbours' indices."""
    g, seg = golay(), segments(fp)
    near = [g.near(s, w) for s, (_, w) in zip(seg, SEGMENTS, strict=True)]
    rows, keys = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        r, c = np.nonzero(near[j][1])
        rows.append(r)
        keys.append((tag << 40) | (seg[i][r].astype(np.int64) << 12) | near[j][0][r, c])
    own = g.index(seg[0]).astype(np.int64)
    r, c, d = np.nonzero(near[1][1][:, :, None] & near[2][1][:, None, :])
    rows.append(r)
    keys.append((6 << 40) | (own[r] << 24) | (near[1][0][r, c].astype(np.int64) << 12) | near[2][0][r, d])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; A-Z are lower-cased."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w), 42)], np.uint64)
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(w) - words]]]
    return np.array([h(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """Columns of ``df`` but the text, and ``fp`` (long)."""
    rest = [c for c in df.columns if c not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(simhash(shingle_hashes(t.as_py() or "", words))) for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(fps, pa.int64())], names=[*rest, "fp"])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("fp", T.LongType())])
    return map_arrow(df.select(*rest, F.col(text_col).alias("__text")), run, schema)


def _keyed(fps: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for at in range(0, len(fp), 2000):
                rows, keys = make(fp[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 2000][rows])], names=["key", "fp"])

    return map_arrow(fps.select("fp"), run, "key long, fp long")


def spanning_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints at ``distance`` bits or fewer: each is compared with all not yet reached."""
    left, out = np.unique(fp).view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(left ^ x) <= distance
            for y in left[close]:
                out.append((_signed(int(x)), _signed(int(y))))
                queue.append(y)
            left = left[~close]
    return out


def _hot_links(members: DataFrame, distance: int) -> DataFrame:
    """Links within each key's members, found in pairs of blocks of about BLOCK fingerprints each."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            found = spanning_links(np.array(held, np.int64), distance)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["src", "dst"])

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("key", "lo", "hi", "fp")]
            for *group, fp in zip(*cols, strict=True):
                if group != now:
                    if held:
                        yield links()
                    now, held = group, []
                held.append(fp)
        if held:
            yield links()

    return map_arrow(dealt, run, "src long, dst long")


def links(fps: DataFrame, distance: int = 3, hot: int = HOT) -> DataFrame:
    """Links (src, dst) that connect all fingerprints (distinct, column fp) at ``distance`` (3 at most) bits or fewer."""
    if distance > 3:
        raise ValueError("the keys cover three differing bits")
    left, right = materialize(_keyed(fps, left_keys), "left"), _keyed(fps, right_keys)
    many = materialize(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot")
    extra = None
    if not many.isEmpty():
        right = materialize(right, "right")
        members = left.join(many, "key", "left_semi").unionByName(right.join(many, "key", "left_semi")).distinct()
        extra = _hot_links(members, distance)
        left, right = (x.join(many, "key", "left_anti") for x in (left, right))
    l, r = left.select("key", F.col("fp").alias("src")), right.select("key", F.col("fp").alias("dst"))
    # Sides grow to many rows a fingerprint, which Spark's estimates miss: by them the driver would broadcast a whole side.
    met = l.join(r.hint("merge"), "key").where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance))
    found = met.select("src", "dst")
    return (found.unionByName(extra) if extra is not None else found).distinct()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, hot: int = HOT) -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id that links reach, its own included."""
    fps = materialize(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words=words), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    found = connected_components(materialize(links(distinct, distance, hot), "links"))
    found = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = materialize(found.join(lowest, "component").select("fp", "component_id"), "lowest")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _near_bits(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, from (node, size, fp): texts whose fingerprints differ in 3 bits at most, one of the smallest standing for those of its fingerprint."""
    one = rows.groupBy("fp").agg(F.min(F.struct("size", "node")).alias("m")).select("fp", F.col("m.node").alias("first"))
    one = materialize(one, "fingerprints")
    same = rows.join(one, "fp").where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y"))
    end = lambda fp, x: one.select(F.col("fp").alias(fp), F.col("first").alias(x))
    met = links(one.select("fp")).join(end("src", "x"), "src").join(end("dst", "y"), "dst").select("x", "y")
    return same.unionByName(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that are in three or more of about ``COUNTED`` texts, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))], names=["s"])

    share = int(1_000_000 * min(1.0, COUNTED / max(1, docs.count())))
    some = docs.select("text").where(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1_000_000)) < share)
    counts = map_arrow(some, run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n >= 3")
    got = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    s, n = got["s"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of a set of shingles, the frequent ones being last in the order."""
    known, counts = frequent
    rank = np.zeros(len(s), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rank = np.where(known[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))][: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]


def _signature(s: np.ndarray) -> bytes:
    """Parity of how many of a set's shingles fall on each bit; as many bits as shingles (a power of two, 64 at least).

    Shingles that two sets share cancel out, so at least as many shingles are
    in one set alone as bits differ. Halves xored give the shorter signature.
    """
    m = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(signatures: np.ndarray) -> np.ndarray:
    half = signatures.shape[1] // 2
    return signatures[:, :half] ^ signatures[:, half:]


def _words_of(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)


def _most_apart(similarity: float) -> float:
    """Shingles that are in one of two sets alone, at most, as a share of both sizes."""
    return (1 - similarity) / (1 + similarity)


def _maybe_alike(a: list[bytes], b: list[bytes], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs their signatures leave possible; ``sizes``: of both sets together. Sets alike have lengths of the same or the next power of two."""
    out = np.zeros(len(a), bool)
    kinds = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for n, m in np.unique(kinds, axis=0).tolist():
        if max(n, m) > 2 * min(n, m):
            continue
        at = np.flatnonzero((kinds == (n, m)).all(1))
        x, y = _words_of([a[i] for i in at]), _words_of([b[i] for i in at])
        x, y = (_folded(x) if n > m else x), (_folded(y) if m > n else y)
        out[at] = np.bitwise_count(x ^ y).sum(1) <= _most_apart(similarity) * sizes[at] + 1e-6
    return out


def _possible_pairs(pairs: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b, alike) rows those that the signatures of (node, size, sig) leave possible."""
    side = lambda x: signatures.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _maybe_alike(batch["sig_a"].to_pylist(), batch["sig_b"].to_pylist(), batch["sizes"].to_numpy(), similarity)
            yield batch.select(["a", "b", "alike"]).filter(pa.array(kept))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_arrow(joined.select("a", "b", "alike", (F.col("size_a") + F.col("size_b")).alias("sizes"), "sig_a", "sig_b"), run, "a long, b long, alike long")


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, size, fp, sig, keys) from (node, text)."""
    frequent = _frequent(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets = [], []
            for t in batch["text"]:
                h = shingle_hashes(t.as_py(), words)
                fps.append(_signed(simhash(h)))
                sets.append(np.unique(h))
            keys = [_prefix(s, frequent, similarity).view(np.int64) if len(s) else [] for s in sets]
            cols = [batch["node"], pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), pa.array(map(_signature, sets), pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "size", "fp", "sig", "keys"])

    return map_arrow(docs.select("node", "text"), run, "node long, size long, fp long, sig binary, keys array<long>")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, s): the set of each node's shingles, from rows that a join left sorted by node, so copies follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes, sets = [], []
            for node, t in zip(batch["node"].to_pylist(), batch["text"], strict=True):
                if node != last:
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))
                last = node
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return map_arrow(docs.select("node", "text"), run, "node long, s array<long>")


def _tile_links(nodes: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links at ``similarity`` that join what is apart: texts outside the largest group are compared with all."""
    names, group, counts = np.unique(groups, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    outside = np.flatnonzero(group != counts.argmax())
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[col]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(outside), len(sets)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part[outside] @ part.T
    alike = (both >= similarity * (size[outside][:, None] + size[None, :] - both.astype(np.float64))) & (group[outside][:, None] != group[None, :])
    r, c = np.nonzero(alike)
    # One link for each two groups is enough.
    _, first = np.unique(np.sort(np.stack([group[outside[r]], group[c]]), axis=0), axis=1, return_index=True) if len(r) else (None, [])
    return [(int(nodes[outside[r[i]]]), int(nodes[c[i]])) for i in first]


def _tile_possible(signatures: list[bytes], sizes: np.ndarray, groups: np.ndarray, similarity: float) -> np.ndarray:
    """Which texts of a tile may be like one of another group."""
    out = np.zeros(len(sizes), bool)
    length = np.array([len(x) for x in signatures])
    for m in np.unique(length).tolist():
        own, longer = np.flatnonzero(length == m), np.flatnonzero(length == 2 * m)
        x = _words_of([signatures[i] for i in own])
        near, y = own, x
        if len(longer):
            near, y = np.concatenate([own, longer]), np.concatenate([x, _folded(_words_of([signatures[i] for i in longer]))])
        step = max(1, 4_000_000 // len(near))
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            apart = np.zeros((len(rows), len(near)), np.int64)
            for k in range(x.shape[1]):
                apart += np.bitwise_count(x[at : at + step, k, None] ^ y[None, :, k])
            hit = (apart <= _most_apart(similarity) * (sizes[rows][:, None] + sizes[near][None, :]) + 1e-6) & (groups[rows][:, None] != groups[near][None, :])
            out[rows] |= hit.any(1)
            out[near] |= hit.any(0)
    return out


def _by_tile(placed: DataFrame, found, schema: str) -> DataFrame:
    """``found(columns)`` (a record batch) over the rows of each ``pair``, in one task each; the columns are lists, binary and array values as Arrow scalars."""
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cols = [list(batch[c]) if c == "s" else batch[c].to_pylist() for c in names]
            for row in zip(*cols, strict=True):
                if row[0] != now:
                    if held:
                        yield found([list(c) for c in zip(*held, strict=True)])
                    now, held = row[0], []
                held.append(tuple(x.values.to_numpy().copy() if isinstance(x, pa.ListScalar) else x for x in row))
        if held:
            yield found([list(c) for c in zip(*held, strict=True)])

    return map_arrow(placed.repartition("pair").sortWithinPartitions("pair"), run, schema)


def _crowded_links(members: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between the groups under each key of ``members`` (key, node, size, sig, part): every pair of texts of different groups is compared.

    A group larger than a block has blocks of its own, which are not paired
    with each other; the other groups share blocks. Pairs of blocks are first
    searched by signatures; the shingle sets of texts that may have a partner
    then decide.
    """
    weight = F.sum(F.col("size") + TEXT)
    blocks = lambda w: F.ceil(w / TILE).cast("int")
    parts = members.groupBy("key", "part").agg(blocks(weight).alias("nb"), weight.alias("w"))
    large = parts.where("nb > 1").select("key", "part", "nb")
    mixed = parts.where("nb = 1").groupBy("key").agg(blocks(F.sum("w")).alias("nb")).withColumn("part", F.lit(None).cast("long"))
    tiles = large.unionByName(mixed).select("key", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), "part", "nb")
    tiles = materialize(tiles.select("key", F.struct("part", "i").alias("tile"), "nb"), "tiles")
    x, y = tiles.select("key", F.col("tile").alias("x")), tiles.select("key", F.col("tile").alias("y"))
    pairs = x.join(y, "key").where((F.col("x") < F.col("y")) | (F.col("x").eqNullSafe(F.col("y")) & F.col("x.part").isNull()))
    pairs = pairs.where(F.col("x.part").isNull() | F.col("y.part").isNull() | (F.col("x.part") != F.col("y.part")))
    pairs = pairs.select("key", F.xxhash64("key", "x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    dealt = members.join(large.withColumnRenamed("nb", "own"), ["key", "part"], "left").join(mixed.select("key", F.col("nb").alias("shared")), "key", "left")
    number = F.pmod(F.xxhash64("node"), F.coalesce("own", "shared")).cast("int")
    dealt = dealt.select("key", "node", "size", "sig", F.col("part").alias("group"), F.struct(F.when(F.col("own").isNotNull(), F.col("part")).alias("part"), number.alias("i")).alias("tile"))
    placed = dealt.alias("d").join(pairs.alias("p"), (F.col("d.key") == F.col("p.key")) & F.col("d.tile").eqNullSafe(F.col("p.tile")))

    def possible(columns: list) -> pa.RecordBatch:
        pair, node, size, sig, group = columns
        kept = _tile_possible(sig, np.array(size, np.int64), np.array(group, np.int64), similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[kept]) for c in (pair, node, group)], names=["pair", "node", "group"])

    maybe = materialize(_by_tile(placed.select("pair", "node", "size", "sig", "group"), possible, "pair long, node long, group long"), "maybe")
    sets = _shingle_sets(docs.join(maybe.select("node").distinct(), "node", "left_semi"), words).dropDuplicates(["node"])

    def links(columns: list) -> pa.RecordBatch:
        _, node, group, s = columns
        found = _tile_links(np.array(node, np.int64), s, np.array(group, np.int64), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _by_tile(maybe.join(sets, "node").select("pair", "node", "group", "s"), links, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component) from (node, text) rows, a text's node being the same in all its copies: texts whose word shingles have a Jaccard similarity of ``similarity`` or more are linked.

    All groups are found, as if every pair had been compared. Texts that meet by
    the Golay keys of their fingerprints are candidates; wordless texts, which
    have no shingles, are linked by these alone. Two other texts alike share a
    shingle as key; each key's texts end in one group, or every pair of them that
    is in different groups has been verified. So the work is linear in the size
    of a group around a hub, and grows with the square only of texts that share
    a crowded key, are in different groups and stay apart.
    """
    prefixes = materialize(_prefixes(docs, words, similarity).dropDuplicates(["node"]), "prefixes")
    signatures = prefixes.select("node", "size", "sig")
    own = prefixes.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    sizes = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(own.join(materialize(sizes, "sizes"), "key"), "shared")
    # How many others a node shares its keys with: greatest for the text that the others are copies of.
    central = shared.groupBy("node").agg(F.sum("n").alias("w"))

    def possible(x: str, y: str):
        """Whether two texts that meet at these places of the order can be alike: at most so many are in common."""
        most = F.least(f"pos_{x}", f"pos_{y}") + 1 + F.least(F.col(f"size_{x}") - F.col(f"pos_{x}"), F.col(f"size_{y}") - F.col(f"pos_{y}")) - 1
        return most >= F.lit(similarity / (1 + similarity)) * (F.col(f"size_{x}") + F.col(f"size_{y}")) - F.lit(1e-6)

    side = lambda df, x: df.select("key", F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("pos").alias(f"pos_{x}"))
    few, many = shared.where(F.col("n") <= FEW), shared.where(F.col("n") > FEW)
    met = side(few, "a").join(side(few, "b"), "key").where(F.col("a") < F.col("b")).where(possible("a", "b")).select("a", "b")
    # Under crowded keys each text meets one hub, the most central of all its keys' ones.
    crowded = materialize(many.join(central, "node"), "crowded")
    hubs = crowded.groupBy("key").agg(F.max(F.struct("w", "node")).alias("hub"))
    hub = crowded.join(hubs, "key").where("node <> hub.node").groupBy("node").agg(F.max("hub").alias("hub"))
    to_hub = hub.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    by_bits = _near_bits(prefixes.select("node", "size", "fp"))
    pairs = met.unionByName(to_hub).unionByName(by_bits).groupBy("a", "b").agg(F.count("*").alias("alike"))
    pairs = materialize(_possible_pairs(pairs, signatures, similarity), "pairs")
    ends = F.explode(F.array("a", "b")).alias("node")

    def verified(some: DataFrame) -> DataFrame:
        needed = some.select(ends).distinct()
        sets = materialize(_shingle_sets(docs.join(needed, "node", "left_semi"), words).dropDuplicates(["node"]), "sets")
        a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        joined = some.join(a, "a").join(b, "b").where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both))
        return materialize(joined.select("a", "b"), "links")

    # First each text with the one most like it; then only what would join groups that are apart still.
    other = F.when(F.col("a") == F.col("node"), F.col("b")).otherwise(F.col("a"))
    best = pairs.select("a", "b", "alike", ends).groupBy("node").agg(F.max_by(other, F.col("alike") * 1024 + F.pmod(F.xxhash64("a", "b"), F.lit(1024))).alias("other"))
    tried = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    found = verified(tried)
    groups = connected_components(found, "a", "b")
    of = lambda n: groups.select(F.col("node").alias(n), F.col("component").alias(f"group_{n}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")
    apart = materialize(apart.join(tried, ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        found = found.unionByName(verified(apart))
        groups = connected_components(found, "a", "b")
    members = crowded.select("key", "node", "size").join(groups, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("part"))
    several = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    members = materialize(members.join(several, "key", "left_semi").join(signatures.select("node", "sig"), "node"), "members")
    if members.isEmpty():
        return groups
    more = materialize(_crowded_links(members, docs, words, similarity), "links")
    return groups if more.isEmpty() else connected_components(found.unionByName(more), "a", "b")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``df``, one of each group of near-duplicates: that of the smallest id (nulls last).

    Equal texts are one node (null texts and empty ones are equal), texts without words one group. Of rows with the same id and text one stays.
    """
    cols = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = named(df, text, row=F.struct(*[F.col(c) for c in cols]), id=F.col(id_col))
    rank = F.struct(F.col("id").isNull().alias("none"), "id")
    nodes = rows.groupBy("node").agg(F.min(rank).alias("low"))
    found = near_duplicates(rows.select("node", "text"), words, similarity)
    joined = nodes.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    keep = joined.groupBy("component").agg(F.min(F.struct("low", "node")).alias("m")).select(F.col("m.node").alias("node"))
    # One row of each text is left before texts are shuffled, so copies do not meet in one task.
    one = rows.groupBy("node").agg(F.min_by("row", rank).alias("row"))
    return one.join(materialize(keep, "keep"), "node").select("row.*")
