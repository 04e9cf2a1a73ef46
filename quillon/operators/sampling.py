"""Exact samples: counts are met, not hoped for."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.callables import run_partitions
from ..shared import computed_once
from .index import with_index

#: Samples of this many rows at most are a bounded sort on each task; places of this many rows at most come to the driver.
FEW = 10_000
#: Draws that are made from one row.
CHUNK = 100_000
#: Hexadecimal digits by which places are counted at a time, and all they have.
DIGITS, ALL_DIGITS = 3, 32


def order_of(seed: int, key: Column | None = None) -> Column:
    """A random place, as 32 hexadecimal digits: the MD5 of seed and key (the same in any engine), or of rand()."""
    text = F.rand(seed).cast("string") if key is None else F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.md5(text.cast("binary"))


def cut_points(placed: DataFrame, wanted: Callable) -> list[tuple]:
    """(group, place, taken, there): the place at which each group's share ends, how many rows of that place are taken, and how many there are.

    ``placed`` has the columns __group and __place; ``wanted(group, n)`` rows of
    each group are taken. Rows are counted by the first digits of their place,
    then only those where a share ends by further digits. The driver gets 16 to
    the power of ``DIGITS`` counts a group at most; no row is sorted or moved.
    """
    spark, schema = placed.sparkSession, placed.schema["__group"].dataType.simpleString()
    ends: list[tuple] = []
    left: dict | None = None  # group to (prefix, rows still to take)
    digits = DIGITS
    while left is None or left:
        rows = placed
        if left is not None:
            small = spark.createDataFrame([(g, p) for g, (p, _) in left.items()], f"__g {schema}, __prefix string")
            rows = placed.join(F.broadcast(small), placed["__group"].eqNullSafe(small["__g"]) & F.col("__place").startswith(F.col("__prefix")))
        counts: dict = {}
        for r in rows.groupBy("__group", F.substring("__place", 1, digits).alias("p")).count().collect():
            counts.setdefault(r[0], []).append((r[1], r[2]))
        following: dict = {}
        for group, found in counts.items():
            take = wanted(group, sum(n for _, n in found)) if left is None else left[group][1]
            for prefix, n in sorted(found):
                if take <= 0:
                    break
                if take <= n and digits == ALL_DIGITS:
                    ends.append((group, prefix, take, n))
                elif take < n:
                    following[group] = prefix, take, n
                elif take == n:
                    ends.append((group, prefix + "g", 0, 0))
                take -= n
            else:
                if take > 0:
                    ends.append((group, "g", 0, 0))
        few = sum(n for *_, n in following.values()) <= FEW
        left = {g: (p, take) for g, (p, take, _) in following.items()}
        digits = ALL_DIGITS if few else min(ALL_DIGITS, digits + DIGITS)
    return ends


def least(placed: DataFrame, wanted: Callable) -> DataFrame:
    """The ``wanted(group, n)`` rows of least place in each group: a filter by the groups' cut points, without a shuffle.

    Of rows that share the place where a share ends, as repeated keys do, any are taken.
    """
    ends = cut_points(placed, wanted)
    if not ends:
        return placed.limit(0)
    kind = placed.schema["__group"].dataType.simpleString()
    small = placed.sparkSession.createDataFrame(ends, f"__g {kind}, __cut string, __taken long, __there long")
    near = placed.join(F.broadcast(small), placed["__group"].eqNullSafe(small["__g"]))
    whole = near.where((F.col("__place") < F.col("__cut")) | ((F.col("__place") == F.col("__cut")) & (F.col("__taken") == F.col("__there"))))
    out = whole.select(*placed.columns)
    for group, place, taken, there in ends:
        if 0 < taken < there:
            out = out.unionByName(placed.where(F.col("__group").eqNullSafe(F.lit(group)) & (F.col("__place") == place)).limit(taken))
    return out


def placed_by(df: DataFrame, seed: int, key: Column | None, **more: Column) -> DataFrame:
    """``df`` with its random places; where these come from rand() they are computed once, as they are counted before they are met."""
    placed = df.withColumns({"__place": order_of(seed, key), **more})
    return computed_once(placed) if key is None else placed


def sample(df: DataFrame, fraction: float, seed: int = 0, key: Column | None = None, replacement: bool = False) -> DataFrame:
    """Exactly floor(n * fraction) rows, those of the least random places."""
    if replacement:
        return drawn(df, lambda _, n: int(n * fraction), seed)
    placed = placed_by(df, seed, key, __group=F.lit(0))
    return least(placed, lambda _, n: int(n * fraction)).drop("__place", "__group")


def take_sample(df: DataFrame, num: int, seed: int = 0, key: Column | None = None, replacement: bool = False) -> DataFrame:
    if replacement:
        return drawn(df, lambda _, n: num if n else 0, seed)
    if num <= FEW:
        return df.withColumn("__place", order_of(seed, key)).orderBy("__place").limit(num).drop("__place")
    return least(placed_by(df, seed, key, __group=F.lit(0)), lambda _, n: min(n, num)).drop("__place", "__group")


def drawn(df: DataFrame, wanted: Callable, seed: int, key: str | None = None) -> DataFrame:
    """``wanted(key, n)`` draws with replacement from the n rows of each key (of all rows without one).

    Rows are put in order of the key and numbered, so a key's rows are a range
    of numbers and one join meets the draws of all keys. The driver gets a row
    a key.
    """
    group = F.col(key) if key else F.lit(0)
    rows = df.withColumns({"__group": group, "__row": F.monotonically_increasing_id()})
    indexed = with_index((rows.orderBy("__group", "__row") if key else rows).drop("__row"), "__idx")
    ranges = indexed.groupBy("__group").agg(F.min("__idx").alias("first"), F.count("*").alias("n")).collect()
    some = [(first, n, take) for g, first, n in ranges if (take := wanted(g, n)) > 0]
    if not some:
        return df.limit(0)
    small = df.sparkSession.createDataFrame(some, "first long, n long, take long")
    # Draws are numbered in two steps, so that no row holds an array of them all and many tasks make them.
    chunks = small.select("*", F.explode(F.expr(f"sequence(0L, (take - 1) div {CHUNK})")).alias("chunk")).repartition(df.sparkSession.sparkContext.defaultParallelism)
    numbers = F.expr(f"sequence(chunk * {CHUNK}L, least(take, (chunk + 1) * {CHUNK}L) - 1)")
    draws = chunks.select("first", "n", F.explode(numbers).alias("draw"))
    # A hash of range and draw, not rand(): the same in any engine and on any run.
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "first", "draw").cast("binary")), 1, 12)
    share = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))
    draws = draws.select((F.col("first") + F.least(F.floor(share * F.col("n")), F.col("n") - 1)).alias("__draw"))
    return indexed.join(draws, F.col("__idx") == F.col("__draw")).drop("__idx", "__draw", "__group")


def sample_by_key(df: DataFrame, fractions: dict, seed: int = 0, order: Column | None = None, key: str = "key", replacement: bool = False) -> DataFrame:
    """int(rows of a key * its fraction) rows of each key; keys without a fraction are dropped."""
    if not fractions:
        return df.limit(0)
    wanted = lambda group, n: int(n * fractions[group] + 1e-9)
    given = F.lit(False)
    for k in fractions:
        given = given | F.col(key).eqNullSafe(F.lit(k))
    kept = df.where(given)
    if replacement:
        return drawn(kept, wanted, seed, key)
    return least(placed_by(kept, seed, order, __group=F.col(key)), wanted).drop("__place", "__group")


def tagged_sample(df: DataFrame, num: int) -> DataFrame:
    """About ``num`` elements, pickled, for pivots, which need not be exact."""
    n = df.count()
    some = df.sample(min(1.0, 1.2 * num / n), seed=1) if n > num else df
    return run_partitions(some, lambda items, context: (pickle.dumps(x) for x in items), "x binary")
