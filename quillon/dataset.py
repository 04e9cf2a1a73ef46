"""Fluent datasets over DataFrames.

A Dataset has elements: the values of its sole column, or rows. A PairDataset
has the columns ``key`` and ``value``. Operations take a Column, SQL text, or
a Python callable with the schema of its results; the first two stay in the
optimizer's sight (pushdown, pruning, code generation), callables run on
Arrow batches. Transformations are lazy; actions return Python values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.callables import Function, batch_of, elements, expression, function, is_expression, is_function, run_partitions, schema_of
from .operators import folds, index, keyed, ordering, partitioning, sampling
from .shared import computed_once

#: Cache levels: none, as the session's default, deserialised, serialised, disk.
NO_CACHE, PRESERVE, MEMORY, RAW_MEMORY, DISK = range(5)
LEVELS = {PRESERVE: StorageLevel.MEMORY_AND_DISK_DESER, MEMORY: StorageLevel.MEMORY_AND_DISK_DESER, RAW_MEMORY: StorageLevel.MEMORY_ONLY, DISK: StorageLevel.DISK_ONLY}

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg, "first": F.first}


class Dataset:
    def __init__(self, df: DataFrame, session=None, variables: dict | None = None):
        self.df, self.session = df, session
        self.variables = dict(variables or {})

    def _new(self, df: DataFrame) -> Dataset:
        kind = PairDataset if df.columns == ["key", "value"] else Dataset
        return kind(df, self.session, self.variables)

    def _element(self) -> Column:
        return F.col(self.df.columns[0]) if len(self.df.columns) == 1 else F.struct(*self.df.columns)

    def with_variables(self, **variables) -> Dataset:
        """Variables for the contexts of the functions that follow."""
        return type(self)(self.df, self.session, self.variables | variables)

    def set_name(self, name: str) -> Dataset:
        return self._new(self.df.alias(name))

    def __eq__(self, other) -> bool:
        return isinstance(other, Dataset) and self.df.sameSemantics(other.df)

    def __hash__(self) -> int:
        return self.df.semanticHash()

    # -- row by row

    def map(self, f, schema=None) -> Dataset:
        if isinstance(f, (list, tuple)):
            return self._new(self.df.select(*[expression(x) for x in f]))
        if is_expression(f):
            return self._new(self.df.select(expression(f).alias("value") if isinstance(f, str) else f))
        g = function(f, 1)
        return self._run(lambda items, _: map(g.call, items), schema, [g])

    def filter(self, f) -> Dataset:
        """Rows for which ``f`` holds (Python truth for a callable); null is no."""
        if is_expression(f):
            return self._new(self.df.where(expression(f)))
        g = function(f, 1)
        return self._run(lambda items, _: (x for x in items if g.call(x)), self.df.schema, [g])

    def flatmap(self, f, schema=None) -> Dataset:
        if is_expression(f):
            return self._new(self.df.select(F.explode(expression(f)).alias("value")))
        g = function(f, 1)
        return self._run(lambda items, _: (y for x in items for y in g.call(x)), schema, [g])

    def key_by(self, f, schema=None) -> PairDataset:
        if is_expression(f):
            return self._new(self.df.select(expression(f).alias("key"), self._element().alias("value")))
        g = function(f, 1)
        element = self.df.schema.fields[0].dataType if len(self.df.columns) == 1 else self.df.schema
        out = T.StructType([T.StructField("key", schema_of(schema).fields[0].dataType), T.StructField("value", element)])
        return self._run(lambda items, _: ((g.call(x), x) for x in items), out, [g])

    def map_with_index(self, f, schema=None) -> Dataset:
        """``f(index, element)``; in an expression the index is the column ``idx``."""
        indexed = index.with_index(self.df, "idx")
        if is_expression(f) or isinstance(f, (list, tuple)):
            return self._new(indexed).map(f)
        g, one = function(f, 2), len(self.df.columns) == 1

        def body(items, _):
            for row in items:
                row = tuple(row)
                yield g.call(row[-1], row[0] if one else row[:-1])

        return self._new(run_partitions(indexed, body, schema, [g], self.variables))

    def zip_with_index(self) -> Dataset:
        return self._new(index.with_index(self.df, "idx"))

    def map_partitions(self, f, schema=None) -> Dataset:
        g = function(f, 1)
        return self._run(lambda items, _: g.call(items), schema, [g])

    def map_partitions_with_index(self, f, schema=None) -> Dataset:
        g = function(f, 2)
        return self._run(lambda items, context: g.call(context.partition, items), schema, [g])

    def map_executor(self, f, schema=None) -> Dataset:
        """``f`` gets the list of an executor's partitions (each a list) and may change them in place."""
        g = function(f, 1)

        def changed(parts: list[list]) -> list[list]:
            g.call(parts)
            return parts

        return self._executor(changed, schema or self.df.schema, [g])

    def map_executor_to(self, f, schema=None) -> Dataset:
        """``f`` gets the list of an executor's partitions and returns another list of partitions."""
        g = function(f, 1)
        return self._executor(g.call, schema, [g])

    def _executor(self, f, schema, functions) -> Dataset:
        n = self.session.executors() if self.session else 1
        tagged = self.df.select(F.spark_partition_id().alias("__pid"), self._element().alias("x")).coalesce(n)

        def body(items, _):
            parts: dict[int, list] = {}
            for pid, x in items:
                parts.setdefault(pid, []).append(x)
            for part in f([parts[k] for k in sorted(parts)]):
                yield from part

        return self._new(run_partitions(tagged, body, schema, functions, self.variables))

    def _run(self, body, schema, functions: Iterable = ()) -> Dataset:
        return self._new(run_partitions(self.df, body, schema, functions, self.variables))

    def to_pair(self) -> PairDataset:
        """Two columns as ``key`` and ``value``; more are the key and a struct of the rest; one must be a pair."""
        cols = self.df.columns
        if len(cols) == 1:
            kind = self.df.schema.fields[0].dataType
            if not isinstance(kind, T.StructType) or len(kind) != 2:
                raise ValueError("elements are no pairs")
            df = self.df.select(*[F.col(cols[0])[f.name].alias(n) for f, n in zip(kind.fields, ("key", "value"), strict=True)])
        else:
            df = self.df.select(F.col(cols[0]).alias("key"), (F.col(cols[1]) if len(cols) == 2 else F.struct(*cols[1:])).alias("value"))
        return PairDataset(df, self.session, self.variables)

    # -- grouping and sets

    def prepared(self, src) -> Dataset:
        """The same elements, read in tasks that run ``src``'s set-up before and its tear-down after them; None leaves all as it is."""
        return self if src is None else self._run(lambda items, _: items, self.df.schema, [function(src, 1)])

    def group_by(self, f, schema=None, partitions: int | None = None) -> PairDataset:
        return self.key_by(f, schema).group_by_key(partitions)

    def distinct(self, partitions: int | None = None, src=None) -> Dataset:
        return self._new(keyed.dealt(self.prepared(src).df.distinct(), partitions, *self.df.columns))

    def union(self, other: Dataset, preserve_order: bool = False, src=None) -> Dataset:
        if src is not None:
            return self.prepared(src).union(other.prepared(src), preserve_order)
        return self._new(partitioning.union_ordered(self.df, other.df) if preserve_order else self.df.unionAll(other.df))

    # -- order

    def sort(self, ascending: bool = True, partitions: int | None = None) -> Dataset:
        return self._new(ordering.sort(self.df, self.df.columns, ascending, partitions))

    def sort_by(self, by, ascending: bool = True, partitions: int | None = None) -> Dataset:
        """By columns (one or a list), or by a Python less-than of two elements."""
        if is_function(by):
            return self._new(ordering.sort_by(self.df, by, ascending, partitions, self.variables))
        by = by if isinstance(by, (list, tuple)) else [by]
        return self._new(ordering.sort(self.df, [expression(b) for b in by], ascending, partitions))

    def top(self, n: int, by=None) -> list:
        return self._extreme(n, by, True)

    def take_ordered(self, n: int, by=None) -> list:
        return self._extreme(n, by, False)

    def _extreme(self, n: int, by, largest: bool) -> list:
        if is_function(by):
            return ordering.top_by(self.df, n, by, largest, self.variables)
        return self._new(self.top_frame(n, by, largest)).collect()

    def top_frame(self, n: int, by=None, largest: bool = True) -> DataFrame:
        by = self.df.columns if by is None else by if isinstance(by, (list, tuple)) else [by]
        return ordering.top(self.df, n, [expression(b) for b in by], largest)

    def max(self, by=None):
        return self._one(self.top(1, by))

    def min(self, by=None):
        return self._one(self.take_ordered(1, by))

    @staticmethod
    def _one(found: list):
        if not found:
            raise ValueError("empty collection")
        return found[0]

    # -- actions

    def collect(self) -> list:
        return [x for b in self.df.toArrow().to_batches() for x in elements(b)]

    def take(self, n: int) -> list:
        return self._new(self.df.limit(n)).collect()

    def count(self) -> int:
        return self.df.count()

    def aggregate_frame(self, *aggregates) -> DataFrame:
        return self.df.agg(*[expression(a) for a in aggregates])

    def _folded(self, f, *rest, **options):
        if isinstance(f, str):
            if len(self.df.columns) != 1 or f not in _AGGREGATES:
                raise ValueError(f"no aggregate of one column is named {f!r}")
            f = _AGGREGATES[f](self.df.columns[0])
        if isinstance(f, Column):
            return self.df.agg(f).first()[0]
        return folds.fold(self.df, f, *rest, **options, variables=self.variables)

    def reduce(self, f):
        """An aggregate by name or Column, or an associative callable, folded in partition order; an empty dataset is an error."""
        return self._folded(f)

    def tree_reduce(self, f):
        return self._folded(f, in_tree=True)

    def aggregate(self, zero, seq, comb):
        """``zero`` must be neutral: each partition starts from a copy of it."""
        return folds.fold(self.df, seq, comb, zero, True, variables=self.variables)

    def tree_aggregate(self, zero, seq, comb):
        return folds.fold(self.df, seq, comb, zero, True, True, variables=self.variables)

    def fold(self, zero, f):
        return folds.fold(self.df, f, None, zero, True, variables=self.variables)

    def tree_fold(self, zero, f):
        return folds.fold(self.df, f, None, zero, True, True, variables=self.variables)

    def foreach(self, f) -> None:
        g = function(f, 1)
        self._drain(lambda items: [g.call(x) for x in items], g)

    def foreach_partition(self, f) -> None:
        g = function(f, 1)
        self._drain(g.call, g)

    def foreach_executor(self, f) -> None:
        """``f`` gets the list of an executor's partitions."""
        g = function(f, 1)

        def seen(parts: list) -> list:
            g.call(parts)
            return []

        self._executor(seen, "value long", [g]).df.foreach(lambda _: None)

    def _drain(self, f, g) -> None:
        def body(items, _):
            f(items)
            return iter(())

        run_partitions(self.df, body, "value long", [g], self.variables).count()

    # -- samples

    def sample(self, fraction: float, seed: int = 0, replacement: bool = False, key=None) -> Dataset:
        return self._new(sampling.sample(self.df, fraction, seed, expression(key) if key is not None else None, replacement))

    def take_sample(self, num: int, seed: int = 0, replacement: bool = False, key=None) -> list:
        return self._new(sampling.take_sample(self.df, num, seed, expression(key) if key is not None else None, replacement)).collect()

    # -- placement

    def repartition(self, n: int, preserve_ordering: bool = False, everywhere: bool = True) -> Dataset:
        return self._new(partitioning.repartition(self.df, n, preserve_ordering, everywhere))

    def partition_by_random(self, n: int, seed: int = 0) -> Dataset:
        return self._new(partitioning.by_random(self.df, n, seed))

    def partition_by_hash(self, n: int, *columns: str) -> Dataset:
        return self._new(partitioning.by_hash(self.df, n, *columns))

    def partition_by(self, f, n: int) -> Dataset:
        """To partition ``f(element)`` mod ``n``."""
        if is_expression(f):
            return self._new(partitioning.by_number(self.df, n, expression(f)))
        g = function(f, 1)
        fields = T.StructType([*self.df.schema.fields, T.StructField("__to", T.LongType())])
        one, pair = len(self.df.columns) == 1, self.df.columns == ["key", "value"]
        body = lambda items, _: ((*((x,) if one and not pair else x), g.call(x)) for x in items)
        tagged = run_partitions(self.df, body, fields, [g], self.variables)
        return self._new(partitioning.by_number(tagged, n, F.col("__to")).drop("__to"))

    def partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def count_by_partition(self) -> dict[int, int]:
        return {r["partition"]: r["n"] for r in index.partition_counts(self.df).collect()}

    def approx_size(self) -> int:
        return partitioning.approx_size(self.df)

    # -- cache

    def persist(self, level: int = PRESERVE) -> Dataset:
        if level == NO_CACHE:
            return self.unpersist()
        self.df.persist(LEVELS[level])
        return self

    def cache(self) -> Dataset:
        return self.persist()

    def unpersist(self) -> Dataset:
        self.df.unpersist()
        return self

    uncache = unpersist

    def checkpoint(self) -> Dataset:
        """A copy in the shared checkpoint folder, which lost executors do not touch."""
        return self._new(computed_once(self.df))

    # -- sinks

    def save_as_text_file(self, path: str, overwrite: bool = False, append: bool = False) -> None:
        from .sources.text import save

        save(self, path, overwrite, append)

    def save_as_json_file(self, path: str, pretty: bool = True, overwrite: bool = False) -> None:
        from .sources.json_array import save

        save(self, path, pretty, overwrite)

    def save_as_object_file(self, path: str, compression: int = 6, overwrite: bool = False) -> None:
        from .sources.objects import save

        save(self, path, compression, overwrite)


class _OfKeys(Function):
    """A comparator of keys as one of pairs."""

    def __init__(self, less: Function):
        self.less = less

    def before(self, context) -> None:
        self.less.before(context)

    def call(self, a, b):
        return self.less.call(a[0], b[0])

    def after(self, context) -> None:
        self.less.after(context)


class PairDataset(Dataset):
    def __init__(self, df: DataFrame, session=None, variables: dict | None = None):
        if df.columns != ["key", "value"]:
            raise ValueError("a pair dataset has the columns key and value")
        super().__init__(df, session, variables)

    def map_values(self, f, schema=None) -> PairDataset:
        if is_expression(f):
            return self._new(self.df.select("key", expression(f).alias("value")))
        g = function(f, 1)
        return self._run(lambda items, _: ((k, g.call(v)) for k, v in items), self._value_schema(schema), [g])

    def flat_map_values(self, f, schema=None) -> PairDataset:
        if is_expression(f):
            return self._new(self.df.select("key", F.explode(expression(f)).alias("value")))
        g = function(f, 1)
        return self._run(lambda items, _: ((k, x) for k, v in items for x in g.call(v)), self._value_schema(schema), [g])

    def _value_schema(self, schema) -> T.StructType:
        return T.StructType([self.df.schema["key"], T.StructField("value", schema_of(schema).fields[0].dataType)])

    def keys(self) -> list:
        return self.keys_dataset().collect()

    def values(self) -> list:
        return self.values_dataset().collect()

    def keys_dataset(self) -> Dataset:
        return self._new(self.df.select(F.col("key").alias("value")))

    def values_dataset(self) -> Dataset:
        return self._new(self.df.select("value"))

    def group_by_key(self, partitions: int | None = None, src=None) -> PairDataset:
        return self._new(keyed.group_values(self.prepared(src).df, partitions))

    def reduce_by_key(self, f, schema=None, partitions: int | None = None, local: bool = True) -> PairDataset:
        """An aggregate of ``value`` by name or Column, or an associative callable."""
        if isinstance(f, str):
            f = _AGGREGATES[f]("value")
        if isinstance(f, Column):
            return self._new(keyed.dealt(self.df.groupBy("key").agg(f.alias("value")), partitions, "key"))
        return self._new(keyed.reduce_by_key(self.df, f, schema, partitions, local, self.variables))

    def aggregate_by_key(self, zero, seq=None, comb=None, schema=None, partitions: int | None = None) -> PairDataset:
        """Aggregate Columns (one, or several as a struct) in place of ``zero``, or Python functions from a zero that each key copies."""
        if isinstance(zero, Column):
            return self.reduce_by_key(zero, partitions=partitions)
        return self._new(keyed.aggregate_by_key(self.df, zero, seq, comb, schema, partitions, self.variables))

    def fold_by_key(self, zero, f, schema=None, partitions: int | None = None, local: bool = True) -> PairDataset:
        """``f`` is associative and ``zero`` neutral, as in ``fold``; unless ``local``, values are shuffled before they are folded."""
        return self._new(keyed.fold_by_key(self.df, zero, f, schema, partitions, local, self.variables))

    def join(self, other: PairDataset, partitions: int | None = None, how: str = "inner", null_safe: bool = True, src=None) -> PairDataset:
        """(key, (left, right)) for each pair of rows of one key; null keys meet."""
        got = keyed.join_pairs(self.prepared(src).df, other.prepared(src).df, partitions, how, null_safe)
        if "left" not in got.columns:
            return self._new(got)
        return self._new(got.select("key", F.struct("left", "right").alias("value")))

    def sort_by_key(self, ascending: bool = True, partitions: int | None = None, less: Callable | None = None) -> PairDataset:
        if less is not None:
            return self._new(ordering.sort_by(self.df, _OfKeys(function(less, 2)), ascending, partitions, self.variables))
        return self._new(ordering.sort(self.df, ["key"], ascending, partitions))

    def key_counts(self) -> PairDataset:
        """(key, number of its rows), lazily and for any number of keys."""
        return self._new(self.df.groupBy("key").agg(F.count("*").alias("value")))

    def value_counts(self) -> PairDataset:
        """(value, number of its rows) as pairs."""
        return self._new(self.df.groupBy(F.col("value").alias("key")).agg(F.count("*").alias("value")))

    def count_by_key(self) -> dict:
        """A dictionary on the driver, which must have room for all keys; see ``key_counts``. Arrays and structs are tuples in it."""
        return {keyed.hashable(k): n for k, n in self.key_counts().collect()}

    def count_by_value(self) -> dict:
        """As ``count_by_key``, of the value part; see ``value_counts``."""
        return {keyed.hashable(v): n for v, n in self.value_counts().collect()}

    def sample_by_key(self, fractions: dict, seed: int = 0, replacement: bool = False, order=None) -> PairDataset:
        return self._new(sampling.sample_by_key(self.df, fractions, seed, expression(order) if order is not None else None, "key", replacement))


__all__ = ["DISK", "MEMORY", "NO_CACHE", "PRESERVE", "RAW_MEMORY", "Dataset", "PairDataset", "batch_of"]
