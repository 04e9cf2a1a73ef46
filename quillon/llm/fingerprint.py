"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations only.

Leaves are the SHA-256 of sentences (cut at 32 code points). A paragraph (line)
hashes its leaves, a section its paragraphs, the root its sections. A section
ends after a paragraph whose hash ends in 0 or 1, so sections find their places
again after an insertion. Equal roots mean equal texts.

The fingerprint is the tree as text: the root, then for each section ``/`` and
16 digits of its hash, for each of its paragraphs ``:`` and 16 digits, followed
by 8 digits of each leaf. Likeness is found by descent: sections in common are
closed, then paragraphs of the open sections, then leaves of the open
paragraphs; it is the share of both texts' leaves that were not left over.

Defined results: a null text has the fingerprint of the empty text, which is
one empty paragraph without leaves; two different texts without leaves have a
likeness of 0. Ids are taken in ascending order, nulls first; rows of one id
are ordered by the XXH64 of their text. An empty table gives an empty result. A
sole document is its own next one. Texts are read whole. Other columns do not
take part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import let, once, part_count

PIECE = r"([^.!?\n]{1,32}[.!?\n]*|[.!?\n]+)"
#: Bytes of input for a range of ids, and keys sampled for each range to cut it even; neither changes a result.
RANGE, SAMPLED = 1 << 24, 64


def tree(text: Column) -> Column:
    """struct(root, sections: array of struct(h, paragraphs: array of struct(h, leaves))) of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    joined = lambda mark, hashes: F.sha2(F.concat(F.lit(mark), F.array_join(hashes, "")), 256)

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, F.lit(PIECE), 1), lambda x: F.sha2(x, 256))
        return let(leaves, lambda x: F.struct(joined("p", x).alias("h"), F.transform(x, lambda y: F.substring(y, 1, 8)).alias("leaves")))

    def sections(p: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == F.size(p) - 1) | F.get(p, i)["h"].rlike("[01]$"))

        def cut(e: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                before = F.coalesce(F.get(e, k - 1), F.lit(-1))
                return let(F.slice(p, before + 2, end - before), lambda own: F.struct(joined("s", _names(own)).alias("h"), own.alias("paragraphs")))

            return F.transform(e, one)

        return let(ends, cut)

    made = let(F.transform(lines, paragraph), sections)
    return let(made, lambda s: F.struct(joined("r", _names(s)).alias("root"), s.alias("sections")))


def _names(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: x["h"])


def encoded(t: Column) -> Column:
    """The fingerprint of a tree."""
    paragraph = lambda p: F.concat(F.lit(":"), F.substring(p["h"], 1, 16), F.array_join(p["leaves"], ""))
    section = lambda s: F.concat(F.lit("/"), F.substring(s["h"], 1, 16), F.array_join(F.transform(s["paragraphs"], paragraph), ""))
    return F.concat(t["root"], F.array_join(F.transform(t["sections"], section), ""))


def _left_over(xs: Column, ys: Column, name) -> Column:
    """Nodes of ``xs`` whose name ``ys`` lacks; looked up in the shorter of two lists, so that few changes in a long text cost little."""
    a, b = F.transform(xs, name), F.transform(ys, name)

    def chosen(lists: Column) -> Column:
        alone, both = lists["alone"], lists["both"]
        by_list = F.when(F.size(alone) < F.size(both), F.filter(xs, lambda x: F.array_contains(alone, name(x))))
        return F.when(F.size(both) == 0, xs).otherwise(by_list.otherwise(F.filter(xs, lambda x: ~F.array_contains(both, name(x)))))

    return let(F.struct(F.array_except(a, b).alias("alone"), F.array_intersect(a, b).alias("both")), chosen)


def _short(node: Column) -> Column:
    return F.substring(node["h"], 1, 16)


def open_paragraphs(a: Column, b: Column) -> Column:
    """Paragraphs of the sections of ``a`` that ``b`` lacks; those of sections in common are not opened."""
    return F.flatten(F.transform(_left_over(a["sections"], b["sections"], _short), lambda s: s["paragraphs"]))


def _descent(a: Column, b: Column) -> Column:
    """struct(x, y): what is left over of each side's paragraphs."""
    opened = F.struct(open_paragraphs(a, b).alias("x"), open_paragraphs(b, a).alias("y"))
    return let(opened, lambda o: F.struct(_left_over(o["x"], o["y"], _short).alias("x"), _left_over(o["y"], o["x"], _short).alias("y")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of both trees' leaves that the descent finds in the other; 1 for equal roots."""
    leaves = lambda ps: F.flatten(F.transform(ps, lambda p: p["leaves"]))
    count = lambda t: F.aggregate(t["sections"], F.lit(0), lambda n, s: n + F.aggregate(s["paragraphs"], F.lit(0), lambda m, p: m + F.size(p["leaves"])))
    same = lambda x: x

    def apart(o: Column) -> Column:
        return let(F.struct(leaves(o["x"]).alias("x"), leaves(o["y"]).alias("y")), lambda e: F.size(_left_over(e["x"], e["y"], same)) + F.size(_left_over(e["y"], e["x"], same)))

    found = 1.0 - let(_descent(a, b), apart) / F.nullif(count(a) + count(b), F.lit(0))
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.coalesce(found, F.lit(0.0)))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Hashes of the paragraphs of ``a`` that are left over against ``b``: where the edits are."""
    return F.when(a["root"] == b["root"], F.array().cast("array<string>")).otherwise(F.array_distinct(_names(_descent(a, b)["x"])))


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its tree in the column ``fingerprint``."""
    return once(df, fingerprint=tree(F.col(text_col)))


def with_next(df: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """(id, text, fingerprint, next_text, next_fingerprint); next: in ascending id, after the last the first.

    No window spans the table: rows are dealt by ranges of (id, hash of the
    text) whose lower bounds are keys that exist, and the row at a bound is
    given to the range before as well, to follow its last row. So one id, or
    none, may fill many ranges. The bounds come from a sample, ``SAMPLED`` keys
    for each range, in one pass. Text is shuffled once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col("id").isNotNull().cast("int").alias("s"), F.coalesce("id", F.lit(0)).cast("long").alias("i"), F.xxhash64("text").alias("h"))
    df = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", key)
    ranges = ranges or part_count(df, RANGE)
    share = int(1e6 * min(1.0, SAMPLED * ranges / max(1, df.count())))
    picked = F.pmod(F.xxhash64(F.lit(23), "key"), F.lit(1_000_000)) < share
    seen = df.agg(F.min("key").alias("low"), F.collect_list(F.when(picked, F.col("key"))).alias("some")).first()
    some = sorted(tuple(k) for k in seen["some"])
    bounds = sorted({some[len(some) * k // ranges] for k in range(1, ranges)} - {tuple(seen["low"])}) if some else []
    # One literal, whatever the number of ranges.
    table = F.from_json(F.lit(json.dumps([dict(zip("sih", b, strict=True)) for b in bounds])), "array<struct<s: int, i: bigint, h: bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    number = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= F.col("key"), at + s).otherwise(at))
    dealt = once(df, bucket=number)
    is_bound = F.coalesce(F.get(table, F.col("bucket") - 1) == F.col("key"), F.lit(False))
    is_first = F.col("key") == F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(seen["low"] or (0, 0, 0), ("int", "long", "long"), "sih", strict=True)])
    place = lambda b, lap: F.struct(b.cast("int").alias("bucket"), F.lit(lap).alias("lap"))
    places = F.array_compact(F.array(
        place(F.col("bucket"), 0),
        F.when(is_bound, place(F.col("bucket") - 1, 1)),
        F.when(is_first, place(F.lit(len(bounds)), 2)),
    ))
    dealt = dealt.select("id", "text", "key", F.explode(places).alias("p")).select("id", "text", "key", "p.*").repartitionById(len(bounds) + 1, F.col("bucket"))
    seen = fingerprints(dealt)
    w = Window.partitionBy("bucket").orderBy("lap", "key", "text")
    lead = F.lead(F.struct("text", "fingerprint")).over(w)
    return seen.withColumn("n", lead).where("lap = 0").select("id", "text", "fingerprint", F.col("n.text").alias("next_text"), F.col("n.fingerprint").alias("next_fingerprint"))


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text against its edit (its last quarter replaced by the next document's first code points) and against the next document."""
    got = with_next(df, id_col, text_col, ranges)
    n = F.length("text").cast("long")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - k), F.substring(F.col("next_text"), F.lit(1), k))
    got = once(got, edited=edited)
    got = once(got, edited_tree=tree(F.col("edited")))
    got = got.withColumnRenamed("fingerprint", "tree").withColumnRenamed("next_fingerprint", "next_tree")
    return got.select(
        F.col("id").alias(id_col),
        n.alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        encoded(F.col("tree")).alias("fingerprint"),
        encoded(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.size(changed_paragraphs(F.col("edited_tree"), F.col("tree"))).cast("long").alias("n_changed_paragraphs"),
    )
