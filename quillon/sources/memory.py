"""Datasets from driver data and from functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from ..dataset import Dataset
from ..functions.callables import function, run_partitions, schema_of


def kind_of(data: list) -> T.DataType:
    """Type of the elements; unlike the session's inference, mixed ones are an error."""
    kinds = {type(x) for x in data if x is not None}
    kinds = {int if k is bool and int in kinds else k for k in kinds}
    if len(kinds) > 1 and not kinds <= {int, float}:
        raise TypeError(f"elements of several types: {sorted(k.__name__ for k in kinds)}")
    from pyspark.sql.pandas.types import from_arrow_type

    found = from_arrow_type(pa.array(data).type) if data else T.LongType()
    return T.StringType() if isinstance(found, T.NullType) else found


def parallelize(session, data, partitions: int | None = None, schema=None) -> Dataset:
    """Lists, iterables, bytes (as numbers 0 to 255) and arrays, in order, split evenly."""
    if isinstance(data, (bytes, bytearray)):
        data, schema = list(data), schema or T.ShortType()
    elif isinstance(data, np.ndarray):
        data = data.tolist()
    else:
        data = list(data)
    spark = session.spark
    n = partitions or spark.sparkContext.defaultParallelism
    pairs = bool(data) and all(isinstance(x, tuple) and len(x) == 2 for x in data)
    if schema is None:
        if pairs:
            schema = T.StructType([T.StructField("key", kind_of([x[0] for x in data])), T.StructField("value", kind_of([x[1] for x in data]))])
        else:
            schema = kind_of(data)
    schema = schema_of(schema)
    rows = [x if isinstance(x, (tuple, dict)) else (x,) for x in data]
    split = spark.sparkContext.parallelize(rows, n)  # keeps order and splits evenly
    df = spark.createDataFrame(split, schema)
    from ..dataset import PairDataset

    return (PairDataset if df.columns == ["key", "value"] else Dataset)(df, session)


def execute_to(session, f, partitions: int, schema) -> Dataset:
    """``f(partition)`` makes each partition's elements."""
    g = function(f, 1)
    seeds = session.spark.range(0, partitions, 1, partitions)
    return Dataset(run_partitions(seeds, lambda items, context: (x for i in items for x in g.call(i)), schema, [g], session.variables), session)


def execute(session, f, tasks: int | None = None) -> None:
    """Run ``f(task)`` once in each of so many tasks that run at the same time."""
    g, n = function(f, 1), tasks or session.executors()
    seeds = session.spark.range(0, n, 1, n)

    def body(items, context):
        for i in items:
            g.call(i)
        return iter(())

    run_partitions(seeds, body, "value long", [g], session.variables, barrier=True).count()
