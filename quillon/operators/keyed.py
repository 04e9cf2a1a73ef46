"""Keyed aggregation, grouping and joins over (key, value) frames."""

from __future__ import annotations

import copy
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.callables import function, pickled, run_partitions, schema_of

#: Keys that a task holds while it combines before the shuffle; more are sent on as they are.
HELD = 100_000
#: Values that a task folds after a shuffle before it sends on what it holds, as accumulators may grow with their values.
FOLDED = 1_000_000


def handle(key):
    """A key as Spark groups it, hashable: NaN equals NaN, arrays, structs and maps are compared by what they hold."""
    if isinstance(key, float):
        return ("nan",) if key != key else key
    if isinstance(key, dict):
        return ("map", frozenset((handle(k), handle(v)) for k, v in key.items()))
    if isinstance(key, (list, tuple)):
        return ("row", *map(handle, key))
    if isinstance(key, bytearray):
        return bytes(key)
    return key


def hashable(key):
    """A key for a dictionary: arrays and structs as tuples, maps as tuples of their pairs."""
    if isinstance(key, dict):
        return tuple(sorted(((hashable(k), hashable(v)) for k, v in key.items()), key=repr))
    return tuple(map(hashable, key)) if isinstance(key, (list, tuple)) else key


def value_type(schema) -> T.DataType:
    return schema if isinstance(schema, T.DataType) else schema_of(schema).fields[0].dataType


def dealt(df: DataFrame, partitions: int | None, *columns: str) -> DataFrame:
    return df.repartition(partitions, *columns) if partitions else df


def group_values(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, value: list); nulls among the values are kept."""
    wrapped = F.collect_list(F.struct("value"))
    return dealt(df, partitions, "key").groupBy("key").agg(F.transform(wrapped, lambda x: x["value"]).alias("value"))


def combine_by_key(df: DataFrame, start, step, merge, schema, partitions: int | None = None, local: bool = True, functions=(), variables: dict | None = None) -> DataFrame:
    """Python aggregation by key: partial results of tasks, then joined in sorted runs, so no task holds all keys.

    ``start(value)`` begins an accumulator, ``step(acc, value)`` adds a value, ``merge(acc, acc)`` joins two.
    Tasks combine the values where they are if ``local``, else after a shuffle by key and by the task that a value
    comes from: a frequent key is the work of many tasks, which pass over its values without a sort. Without
    ``merge`` all values of a key are one task's, in a sort.
    """
    key_type = df.schema["key"].dataType
    out = T.StructType([T.StructField("key", key_type), T.StructField("value", value_type(schema))])
    between = T.StructType([T.StructField("key", key_type), T.StructField("value", T.BinaryType())])

    def before(items, context):
        held: dict = {}
        for n, (k, v) in enumerate(items):
            h = handle(k)
            if len(held) >= HELD and h not in held or not local and n and n % FOLDED == 0:
                yield from ((a, pickled(b)) for a, b in held.values())
                held.clear()
            if h in held:
                held[h][1] = step(held[h][1], v)
            else:
                held[h] = [k, start(v)]
        yield from ((a, pickled(b)) for a, b in held.values())

    def after(items, context):
        now = key = acc = None
        some = False
        for k, v in items:
            x, h = pickle.loads(v) if merge else v, handle(k)
            if some and h == now:
                acc = merge(acc, x) if merge else step(acc, x)
            else:
                if some:
                    yield key, acc
                now, key, some = h, k, True
                acc = x if merge else start(x)
        if some:
            yield key, acc

    parts = df.select("key", "value")
    if merge:
        parts = run_partitions(parts if local else parts.repartition("key", F.spark_partition_id()), before, between, functions, variables)
    spread = parts.repartition(partitions, "key") if partitions else parts.repartition("key")
    return run_partitions(spread.sortWithinPartitions("key"), after, out, functions, variables)


def reduce_by_key(df: DataFrame, f, schema=None, partitions: int | None = None, local: bool = True, variables: dict | None = None) -> DataFrame:
    g = function(f, 2)
    return combine_by_key(df, lambda v: v, g.call, g.call, schema or df.schema["value"].dataType, partitions, local, [g], variables)


def aggregate_by_key(df: DataFrame, zero, seq, comb, schema, partitions: int | None = None, variables: dict | None = None, local: bool = True) -> DataFrame:
    """Each key has a copy of ``zero`` of its own; without ``comb`` all values of a key are shuffled to one task before they are folded."""
    s = function(seq, 2)
    c = s if comb is seq else function(comb, 2) if comb else None
    start = lambda v: s.call(copy.deepcopy(zero), v)
    return combine_by_key(df, start, s.call, c.call if c else None, schema, partitions, local, [s] if c is None or c is s else [s, c], variables)


def fold_by_key(df: DataFrame, zero, f, schema=None, partitions: int | None = None, local: bool = True, variables: dict | None = None) -> DataFrame:
    """``f`` joins accumulators too; if they are of another type than values it cannot, and a fold that is not ``local`` does without."""
    kind = df.schema["value"].dataType
    joins = local or not schema or value_type(schema).simpleString() == kind.simpleString()
    return aggregate_by_key(df, zero, f, f if joins else None, schema or kind, partitions, variables, local)


def join_pairs(left: DataFrame, right: DataFrame, partitions: int | None = None, how: str = "inner", null_safe: bool = True) -> DataFrame:
    """(key, left, right) for each pair of rows of one key; null keys meet unless ``null_safe`` is off.

    Spark picks the strategy: a side is broadcast only under the session's size
    threshold, and skewed keys of a sort-merge join are split by AQE. A number of
    partitions places the result, so that it does not stand in AQE's way.
    """
    l = left.select("key", F.col("value").alias("left"))
    r = right.select(F.col("key").alias("__key"), F.col("value").alias("right"))
    match = F.col("key").eqNullSafe(F.col("__key")) if null_safe else F.col("key") == F.col("__key")
    joined = l.join(r, match, how)
    if how in ("left_semi", "left_anti"):
        return dealt(joined.withColumnRenamed("left", "value"), partitions, "key")
    return dealt(joined.select(F.coalesce("key", "__key").alias("key"), "left", "right"), partitions, "key")
