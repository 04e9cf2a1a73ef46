"""Sorting, also by a comparator, and top-k."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from functools import partial
from heapq import nsmallest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.callables import elements, function, run_partitions, running
from .sampling import tagged_sample


def sort(df: DataFrame, columns: list, ascending: bool = True, partitions: int | None = None) -> DataFrame:
    """Global order; nulls first ascending, last descending. Ties are in no certain order."""
    by = [(F.col(c) if isinstance(c, str) else c) for c in columns]
    by = [c.asc() if ascending else c.desc() for c in by]
    return df.repartitionByRange(partitions, *by).sortWithinPartitions(*by) if partitions else df.orderBy(*by)


class _Place:
    """An element as a sort key by a less-than function."""

    __slots__ = ("f", "up", "x")

    def __init__(self, f, up: bool, x):
        self.f, self.up, self.x = f, up, x

    def __lt__(self, other: _Place) -> bool:
        return bool(self.f.call(self.x, other.x) if self.up else self.f.call(other.x, self.x))


def _ordered(less, ascending: bool):
    """A sort key from a less-than function, with its Function."""
    f = function(less, 2)
    return f, partial(_Place, f, ascending)


def sort_by(df: DataFrame, less, ascending: bool = True, partitions: int | None = None, variables: dict | None = None) -> DataFrame:
    """Order by a Python less-than: pivots from a bounded sample deal ranges out, and each is sorted in its task."""
    n = partitions or df.rdd.getNumPartitions()
    f, key = _ordered(less, ascending)
    picked = [pickle.loads(r[0]) for r in tagged_sample(df, 64 * n).collect()]
    with running(f, variables):
        picked.sort(key=key)
    pivots = [picked[len(picked) * i // n] for i in range(1, n)] if picked else []
    dealt = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def deal(items, context):
        keys = [key(p) for p in pivots]
        for x in items:
            yield bisect_left(keys, key(x)), pickle.dumps(x)

    def order(items, context):
        yield from sorted((pickle.loads(r[1]) for r in items), key=key)

    spread = run_partitions(df, deal, dealt, [f], variables).repartitionById(n, F.col("to"))
    return run_partitions(spread, order, df.schema, [f], variables)


def top(df: DataFrame, n: int, columns: list, largest: bool = True) -> DataFrame:
    """A TakeOrderedAndProject: each task keeps ``n`` rows."""
    by = [(F.col(c) if isinstance(c, str) else c) for c in columns]
    return df.orderBy(*[c.desc() if largest else c.asc() for c in by]).limit(n)


def top_by(df: DataFrame, n: int, less, largest: bool = True, variables: dict | None = None) -> list:
    """By a Python less-than; ``n`` elements a partition come to the driver."""
    f, key = _ordered(less, not largest)

    def best(items, context):
        yield from nsmallest(n, items, key=key)

    rows = run_partitions(df, best, df.schema, [f], variables).toArrow()
    found = [x for b in rows.to_batches() for x in elements(b)]
    with running(f, variables):
        return nsmallest(n, found, key=key)
