"""Exact removal of repeated strings of ``length`` bytes or more, corpus wide.

Suffixes are ranked by sorting (hashing) ranks of growing prefixes, and only
those whose rank is not unique go on, until they are unique or past the
threshold. Ranking every byte position would move tens of times the corpus, so
the positions ranked are samples: in each string of ``length`` bytes the
position whose first ``prefix`` bytes have the least hash (the rightmost of
equals). Equal strings choose the same place, so a repeat of ``length`` bytes
always has a sample of equal prefix at equal offset in both places.

Rank 1: the first ``prefix`` bytes; samples of unique rank are done.
Rank 2: all the strings that hold the sample, as one (its hull). Where another
hull is equal, all of these strings repeat.
Rank 3, for hulls at the edge of a repeat: each string. The hulls of a class
meet in one task if they are ``hot`` at most. Of larger classes (a line that a
third of all documents hold) ranges of 30 strings are ranked first, by the
bytes that a range has in common (a unique one is done), then as a whole, then
ranges of 6 and of 2 of those that are left, and at last single strings, all by
groupings with partial aggregation: a group tells by its lowest and highest
occurrence whether it has more than one. Ranges of equal common bytes are a
class of their own, which meets in one task as soon as ``hot`` are left at most.
Equal texts are one; they are repeats of each other as a whole.

``doubled_spans`` is prefix doubling over all positions, for texts that leave
room for it: it gives the same result and moves many times the corpus.

Defined results: a null text counts as empty; texts under ``length`` bytes have
nothing removed; repeated rows are copies of each other; an empty table gives an
empty result; other columns pass through ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, materialize, named, once, worker_cache

LENGTH, PREFIX = 200, 48
#: Strings of the ranges that hot classes are ranked by, before single ones.
RANGES = (30, 6, 2)
#: Classes of more hulls than this are ranked by groupings alone, others in one task each (some 10 KB a hull).
HOT = 2000
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FULL = np.uint64((1 << 64) - 1)


class Sampler:
    """Sampled positions of byte strings."""

    def __init__(self, length: int, prefix: int):
        self.length, self.prefix, self.window = length, prefix, length - prefix + 1
        self.up = self._powers(_BASE)
        self.down = self._powers(pow(_BASE, -1, 1 << 64))

    @staticmethod
    def _powers(base: int, n: int = 2 * SEGMENT + (1 << 16)) -> np.ndarray:
        out = np.full(n, base & (1 << 64) - 1, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _over(self, x: np.ndarray, best) -> np.ndarray:
        """best of each run of ``window`` entries."""
        size = 1
        while 2 * size <= self.window:
            x = best(x[:-size], x[size:])
            size *= 2
        return best(x[: len(x) - (self.window - size)], x[self.window - size :]) if size < self.window else x

    def select(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, position in it, hash of its prefix) of the samples."""
        k, w = self.prefix, self.window
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=total[1:])
        x = (total[k:] - total[:-k]) * self.up[: len(data) - k + 1]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        # The low bits make the rightmost of equal hashes the least; strings are far shorter than 2 ** 22.
        low = np.uint64((1 << 22) - 1)
        order = (x | low) - (np.arange(len(x), dtype=np.uint64) & low)
        for e in ends:
            order[max(0, e - k + 1) : e] = _FULL
        least = self._over(order, np.minimum)
        edge = np.zeros(w - 1, np.uint64)
        most = self._over(np.concatenate([edge, least, edge]), np.maximum)
        at = np.flatnonzero((most == order) & (order != _FULL))
        piece = np.searchsorted(ends, at, side="right")
        return piece, at - np.concatenate([[0], ends])[piece], x[at]

    def samples(self, texts: list[bytes]) -> list[list]:
        """[text, position, left, right, prefix hash, hull hash] columns; left and right: bytes of the hull before and from the position."""
        found: list[tuple[np.ndarray, ...]] = []
        pieces, owner, start, size, split = [], [], [], 0, False

        def flush() -> None:
            nonlocal size
            if pieces:
                p, at, x = self.select(pieces)
                found.append((np.array(owner)[p], at + np.array(start)[p], x))
            pieces.clear()
            owner.clear()
            start.clear()
            size = 0

        for i, t in enumerate(texts):
            if len(t) < self.length:
                continue
            for s in range(0, len(t) - self.length + 1, SEGMENT):
                part = t[s : s + SEGMENT + self.length - 1]
                split |= s > 0
                pieces.append(part)
                owner.append(i)
                start.append(s)
                size += len(part)
                if size > SEGMENT:
                    flush()
        flush()
        if not found:
            return [[], [], [], [], [], []]
        who, at, x = (np.concatenate(c) for c in zip(*found, strict=True))
        if split:  # the parts of a long text overlap
            _, first = np.unique(np.stack([who, at]), axis=1, return_index=True)
            who, at, x = who[first], at[first], x[first]
        n = np.array([len(t) for t in texts])[who]
        left = np.minimum(at, self.window - 1)
        right = np.minimum(self.length, n - at)
        real = left + right >= self.length
        who, at, x, left, right = who[real], at[real], x[real], left[real], right[real]
        h = xxhash.xxh3_64_intdigest
        hull = np.array([h(texts[i][p - a : p + b], a) for i, p, a, b in zip(who.tolist(), at.tolist(), left.tolist(), right.tolist(), strict=True)], np.uint64)
        return [who, at, left, right, x.view(np.int64), hull.view(np.int64)]


    def shared_runs(self, cls: np.ndarray, at: np.ndarray, is_open: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, least s, greatest s) of the runs of strings, s bytes before an open row's sample, that another row of its class has too."""
        n, w, size = len(data), self.window, self.length
        left, right = (at >> 16 & 0xFFFF).astype(int), (at & 0xFFFF).astype(int)
        width = w - 1 + size
        table = np.zeros((n, width), np.uint64)
        for i, d in enumerate(data):
            start = w - 1 - left[i]
            table[i, start : start + len(d)] = np.frombuffer(d, np.uint8)
        total = np.zeros((n, width + 1), np.uint64)
        np.cumsum((table + np.uint64(1)) * self.down[:width], axis=1, out=total[:, 1:])
        starts = w - 1 - np.arange(w)
        strings = (total[:, starts + size] - total[:, starts]) * self.up[starts]
        strings = (strings ^ (cls.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]) * np.uint64(_BASE)
        s = np.arange(w)
        real = (s >= (size - right)[:, None]) & (s <= left[:, None])
        hit = np.zeros((n, w), bool)
        for k in range(w):
            rows = np.flatnonzero(real[:, k])
            order = rows[np.argsort(strings[rows, k], kind="stable")]
            same = strings[order[1:], k] == strings[order[:-1], k]
            hit[order[1:], k] |= same
            hit[order[:-1], k] |= same
        hit &= is_open[:, None]
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        return who, low, high - 1


def sampler(length: int, prefix: int) -> Sampler:
    return worker_cache(("sampler", length, prefix), lambda: Sampler(length, prefix))


def _samples(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """(cls, hull, node, at) rows; at: position, left and right in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(length, prefix)
        for batch in batches:
            nodes = batch["node"].to_numpy()
            who, at, left, right, cls, hull = s.samples(batch["text"].cast(pa.large_binary()).to_pylist())
            if len(who):
                packed = (at.astype(np.int64) << 32) | (left.astype(np.int64) << 16) | right.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls, hull, nodes[who], packed)], names=["cls", "hull", "node", "at"])

    return map_arrow(docs.where(F.octet_length("text") >= length).select("node", "text"), run, "cls long, hull long, node long, at long")


def _position():
    return F.shiftright("at", 32)


def _left():
    return F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _right():
    return F.col("at").bitwiseAND(F.lit(0xFFFF).cast("long"))


def _ranked(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows with ``shared`` (another occurrence has an equal hull; given for open rows), ``rep`` and ``n``.

    rows: the columns ``by``, hull, node, at, open and others. ``rep`` stands for
    its hull in the next rank, given where the ``n`` hulls of ``by`` are
    several and one is of an open row that no other has.
    """
    occ = F.xxhash64("node", "at")
    g = rows.groupBy(*by, "hull").agg(F.min(occ).alias("lo"), F.max(occ).alias("hi"), F.max("open").alias("any"))
    alone = F.col("lo") == F.col("hi")
    active = g.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.col("any") & alone).alias("some")).where("n > 1 and some").select(*by, "n")
    g = g.join(active, by, "left").where(~alone | F.col("n").isNotNull()).select(*by, "hull", "lo", "hi", "n")
    g = materialize(g, "groups")
    got = rows.join(g, [*by, "hull"]).withColumns({"shared": ~alone, "rep": F.col("n").isNotNull() & (F.col("lo") == occ)}).drop("lo", "hi")
    return materialize(got.where((F.col("shared") & F.col("open")) | F.col("rep")), label)


def _few(hulls: DataFrame, length: int, window: int) -> DataFrame:
    """(node, start, end) of the strings that repeat within a class, from (cls, node, at, open, bytes) rows; classes are held whole."""
    dealt = hulls.repartition("cls").sortWithinPartitions("cls", "node", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(length, length - window + 1)
        held, last = [], None

        def found() -> pa.RecordBatch:
            cls, node, at, is_open, data = (list(c) for c in zip(*held, strict=True))
            runs = s.shared_runs(np.array(cls, np.int64), np.array(at, np.int64), np.array(is_open), data)
            pos = np.array(at, np.int64) >> 32
            who, low, high = runs
            return pa.RecordBatch.from_arrays([pa.array(np.array(node, np.int64)[who]), pa.array(pos[who] - high), pa.array(pos[who] - low + length)], names=["node", "start", "end"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("cls", "node", "at", "open", "bytes")), strict=True):
                if row[:3] == last:
                    continue
                if len(held) >= 2000 and row[0] != last[0]:
                    yield found()
                    held.clear()
                held.append(row)
                last = row[:3]
        if held:
            yield found()

    return map_arrow(dealt, run, "node long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, prefix: int | None = None, hot: int = HOT) -> DataFrame:
    """(node, spans) from (node, text) rows: byte ranges, perhaps overlapping, whose union is all that repeats."""
    prefix = prefix or min(PREFIX, length // 2)
    if not 8 <= prefix < length < 1 << 15:
        raise ValueError("length must be over 16 and under 32,768 bytes")
    window = length - prefix + 1
    samples = _samples(docs, length, prefix)
    # Written first, as are the groups in _ranked: a join of two plain exchanges is one whose hot keys Spark splits.
    often = materialize(samples.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"), "often")
    rows = materialize(samples.join(often, "cls", "left_semi"), "samples")

    one = _ranked(rows.select("cls", "hull", "node", "at", F.lit(True).alias("open")), ["cls"], "hulls")
    spans = [_copies(docs, length), one.where("shared and open").select("node", (_position() - _left()).alias("start"), (_position() + _right()).alias("end"))]

    # The bytes of the hulls that go on.
    wanted = one.where("rep").select("node", "cls", "at", (F.col("open") & ~F.col("shared")).alias("open"), (F.col("n") > hot).alias("hot"))
    wanted = wanted.groupBy("node").agg(F.collect_set(F.struct("cls", "at", "open", "hot")).alias("want"))
    texts = once(docs.select("node", "text").join(wanted, "node"), bytes=F.col("text").cast("binary"))

    def cut(w):  # in one pass over a text's samples, so no row carries the text for each of them
        left, right = (F.shiftright(w["at"], k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in (16, 0))
        first = F.shiftright(w["at"], 32) - left + 1
        return F.struct(w["cls"].alias("cls"), w["at"].alias("at"), w["open"].alias("open"), w["hot"].alias("hot"), F.substring(F.col("bytes"), first.cast("int"), (left + right).cast("int")).alias("bytes"))

    hulls = texts.select("node", F.explode(F.transform("want", cut)).alias("w")).select("node", "w.*")
    hulls = materialize(hulls.select("cls", "node", "at", "open", "hot", "bytes"), "bytes")
    more, small = _many(hulls.where("hot").drop("hot"), length, window, hot)
    few = hulls.where("not hot").drop("hot")
    for x in small:
        few = few.unionByName(x)
    spans += [_few(few, length, window), *more]

    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    got = materialize(every.distinct().groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    return got


def _many(hulls: DataFrame, length: int, window: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The same for classes of any size: ranges of strings and then single ones, each a group that is summed up before it is shuffled.

    Second: ranges in classes of ``hot`` at most, as shorter hulls for ``_few``.
    """
    if hulls.isEmpty():
        return [], []
    # Dealt out anew: the members of one class may lie in a few files, and each becomes up to window / RANGE rows.
    hulls = hulls.repartition("cls", "node", "at")
    piece = lambda before, size: F.substring(F.col("bytes"), _left().cast("int") - before + 1, size)
    now = hulls.select("cls", "node", "at", "open", "bytes", (F.lit(length) - _right()).cast("int").alias("s1"), _left().cast("int").alias("s2"))
    spans, few = [], []
    for size in RANGES:
        ranges = now.withColumn("j", F.explode(F.sequence(F.floor(F.col("s1") / size).cast("int"), F.floor(F.col("s2") / size).cast("int"))))
        a, b = F.col("j") * size, F.least(F.col("j") * size + size - 1, F.lit(window - 1))
        ranges = ranges.withColumns({"s1": F.greatest(a, "s1"), "s2": F.least(b, "s2")})
        common = F.xxhash64(F.col("j"), piece(a, F.lit(length) - (b - a)))
        whole = F.xxhash64("s1", "s2", piece(F.col("s2"), F.lit(length) + F.col("s2") - F.col("s1")))
        # Written once: ranking reads them twice.
        cut = materialize(ranges.select("cls", common.alias("key"), whole.alias("hull"), "node", "at", "open", "s1", "s2"), "cut")
        ranked = _ranked(cut, ["cls", "key"], "ranges")
        spans.append(ranked.where("shared and open").select("node", (_position() - F.col("s2")).alias("start"), (_position() - F.col("s1") + length).alias("end")))
        left = ranked.where("rep").select("cls", "key", "node", "at", "s1", "s2", "n", (F.col("open") & ~F.col("shared")).alias("open"))
        left = left.join(hulls.select("cls", "node", "at", "bytes"), ["cls", "node", "at"])
        at = F.shiftleft(_position(), 32) + F.shiftleft(F.col("s2").cast("long"), 16) + (F.lit(length) - F.col("s1")).cast("long")
        shorter = piece(F.col("s2"), F.lit(length) + F.col("s2") - F.col("s1"))
        few.append(left.where(F.col("n") <= hot).select(F.xxhash64("cls", "key").alias("cls"), "node", at.alias("at"), "open", shorter.alias("bytes")))
        now = left.where(F.col("n") > hot).drop("key", "n")

    last = now.withColumn("s", F.explode(F.sequence("s1", "s2")))
    last = last.select("cls", F.xxhash64("s", piece(F.col("s"), F.lit(length))).alias("hull"), "node", "at", "s", "open")
    last = materialize(last, "strings")
    occ = F.xxhash64("node", "at")
    shared = last.groupBy("cls", "hull").agg(F.min(occ).alias("lo"), F.max(occ).alias("hi")).where("lo <> hi").select("cls", "hull")
    three = last.where("open").join(shared, ["cls", "hull"], "left_semi")
    return [*spans, three.select("node", (_position() - F.col("s")).alias("start"), (_position() - F.col("s") + length).alias("end"))], few


def _copies(docs: DataFrame, length: int) -> DataFrame:
    """(node, start, end): texts that more than one row has, as a whole."""
    copies = docs.groupBy("node").agg(F.count("*").alias("n"), F.min(F.octet_length("text")).cast("long").alias("end"))
    return copies.where((F.col("n") > 1) & (F.col("end") >= length)).select("node", F.lit(0).cast("long").alias("start"), "end")


def doubled_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """As ``repeated_spans``, by prefix doubling over every byte position.

    A position's first rank is the hash of its first bytes, an odd share of
    ``length`` that doubles to it. Positions are sorted by rank, those of a rank
    of its own are done; a position's next rank is the pair of its own and that
    of the position one prefix on, until the prefix has ``length`` bytes.
    """
    step = length
    while step % 2 == 0 and step > 8:
        step //= 2
    first = step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            for node, text in zip(batch["node"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                data = text.as_py()
                for at in range(0, len(data) - first + 1, SEGMENT):
                    n = min(SEGMENT, len(data) - first + 1 - at)
                    ranks = np.array([h(data[i : i + first]) for i in range(at, at + n)], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node, np.int64)), pa.array(np.arange(at, at + n)), pa.array(ranks)], names=["node", "at", "rank"])

    some = docs.where(F.octet_length("text") >= length).dropDuplicates(["node"])
    ranks = materialize(map_arrow(some.select("node", "text"), run, "node long, at long, rank long"), "ranks")
    while True:
        often = materialize(ranks.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), "often")
        ranks = materialize(ranks.join(often, "rank", "left_semi"), "ranks")
        if step >= length:
            break
        ahead = ranks.select("node", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        ranks = ranks.join(ahead, ["node", "at"]).select("node", "at", F.xxhash64("rank", "next").alias("rank"))
        step *= 2
    found = ranks.select("node", F.col("at").alias("start"), (F.col("at") + length).alias("end")).unionByName(_copies(docs, length))
    return materialize(found.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    runs: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or []):
        if runs and s <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], e)
        else:
            runs.append((s, e))
    return runs


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def at_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs drawn in to whole characters."""
    out = []
    for s, e in runs:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _applied(df: DataFrame, text_col: str, length: int, keep: list[str], fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    rows = named(df, F.coalesce(F.col(text_col), F.lit("")), row=F.struct(*df.columns))
    spans = repeated_spans(rows.select("node", "text"), length)
    joined = rows.join(spans, "node", "left").select(*[F.col(f"row.{c}").alias(f"__c{i}") for i, c in enumerate(keep)], "text", "spans")
    schema = T.StructType([*[T.StructField(f"__c{i}", df.schema[c].dataType) for i, c in enumerate(keep)], *[T.StructField(f"__f_{n}", t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            got = [make(t.as_py(), merged(s.as_py())) for t, s in zip(texts, batch["spans"], strict=True)]
            cols = [pa.array([x[i] for x in got], t) for i, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=schema.names)

    return map_arrow(joined, run, schema)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``df``."""

    def make(data: bytes, runs: list[tuple[int, int]]) -> tuple:
        kept = without(data, runs)
        return len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()

    fields = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string())]
    got = _applied(df, text_col, length, [id_col], fields, make)
    return got.select(F.col("__c0").alias(id_col), *[F.col(f"__f_{n}").alias(n) for n, _, _ in fields])


def deduplicated(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with what repeats taken out of its text, by whole characters; a null text becomes empty."""
    fields = [("text", T.StringType(), pa.string())]
    make = lambda data, runs: (without(data, at_characters(data, runs)).decode(),)
    keep = [c for c in df.columns if c != text_col]
    got = _applied(df, text_col, length, keep, fields, make)
    where = {c: f"__c{i}" for i, c in enumerate(keep)} | {text_col: "__f_text"}
    return got.select(*[F.col(where[c]).alias(c) for c in df.columns])
