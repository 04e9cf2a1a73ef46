"""Folds with Python functions: a partial result a partition, combined on the driver or in a tree."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.callables import Function, function, pickled, run_partitions, running

FAN_IN = 8


def partials(df: DataFrame, step: Function, zero: Callable | None, variables: dict | None = None) -> DataFrame:
    """(pid, acc): each partition's left fold, pickled; none for a partition without rows unless there is a zero."""

    def body(items, context):
        started = zero is not None
        acc = zero() if started else None
        for x in items:
            if started:
                acc = step.call(acc, x)
            else:
                acc, started = x, True
        if started:
            yield context.partition, pickled(acc)

    return run_partitions(df, body, "pid int, acc binary", [step], variables)


def combine(parts: DataFrame, step: Function, zero: Callable | None = None, variables: dict | None = None):
    """Fold of the partials on the driver, in partition order: one small value a partition."""
    accs = [pickle.loads(r["acc"]) for r in sorted(parts.collect(), key=lambda r: r["pid"])]
    if not accs:
        if zero is None:
            raise ValueError("empty collection")
        return zero()
    with running(step, variables):
        acc = accs[0]
        for x in accs[1:]:
            acc = step.call(acc, x)
    return acc


def tree(parts: DataFrame, step: Function, partitions: int, variables: dict | None = None) -> DataFrame:
    """Partials combined FAN_IN at a time by the executors until FAN_IN at most are left."""
    while partitions > FAN_IN:
        partitions = -(-partitions // FAN_IN)
        near = parts.withColumn("to", (F.col("pid") / FAN_IN).cast("int")).repartitionById(partitions, F.col("to")).sortWithinPartitions("pid").select("pid", "acc")

        def body(items, context):
            acc, started = None, False
            for row in items:
                x = pickle.loads(row[1])
                acc, started = (step.call(acc, x), True) if started else (x, True)
            if started:
                yield context.partition, pickled(acc)

        parts = run_partitions(near, body, "pid int, acc binary", [step], variables)
    return parts


def fold(df: DataFrame, f, g=None, zero=None, with_zero: bool = False, in_tree: bool = False, variables: dict | None = None):
    """Reduce, fold or aggregate: ``f`` within partitions (from a copy of ``zero``), ``g`` (else ``f``) between them."""
    first, second = function(f, 2), function(g or f, 2)
    make = (lambda: copy.deepcopy(zero)) if with_zero else None
    parts = partials(df, first, make, variables)
    if in_tree:
        parts = tree(parts, second, df.rdd.getNumPartitions(), variables)
    return combine(parts, second, make, variables)
