"""User functions: columns, SQL text, or Python with a life cycle."""

from __future__ import annotations

import inspect
import pickle
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Context:
    """What a function may ask for: its partition and the variables it was given."""

    def __init__(self, variables: dict | None = None):
        self.variables = dict(variables or {})

    @property
    def partition(self) -> int:
        task = TaskContext.get()
        return task.partitionId() if task else 0

    def barrier(self) -> None:
        """Wait for all tasks of the stage; in ``execute`` and other barrier stages only."""
        BarrierTaskContext.get().barrier()

    def all_gather(self, message: str = "") -> list[str]:
        """Each task's message, by task; in barrier stages only."""
        return BarrierTaskContext.get().allGather(message)


class Function:
    """A function with set-up and tear-down, each called once a task."""

    def before(self, context: Context) -> None:
        """Called before the first element."""

    def call(self, *args):
        raise NotImplementedError

    def after(self, context: Context) -> None:
        """Called after the last element, also when the task failed."""


class _Plain(Function):
    def __init__(self, f: Callable, arity: int):
        self.f, self.context = f, None
        try:
            kinds = [p for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]
        except (TypeError, ValueError):
            kinds = []
        self.wants_context = len(kinds) == arity + 1

    def before(self, context: Context) -> None:
        self.context = context

    def call(self, *args):
        return self.f(*args, self.context) if self.wants_context else self.f(*args)


@contextmanager
def running(f: Function, variables: dict | None = None):
    """The life cycle around calls that the driver makes itself."""
    context = Context(variables)
    f.before(context)
    try:
        yield f
    finally:
        f.after(context)


def function(f, arity: int) -> Function:
    """A Function, or what has its three methods, as it is; a plain one with one parameter more than ``arity`` gets the context as its last."""
    return f if _whole(f) else _Plain(f, arity)


def _whole(f) -> bool:
    return isinstance(f, Function) or not isinstance(f, Column) and all(callable(getattr(f, n, None)) for n in ("before", "call", "after"))


def is_function(f) -> bool:
    """Whether ``f`` is Python to be called, not an expression."""
    return not is_expression(f) and (_whole(f) or callable(f))


def is_expression(f) -> bool:
    return isinstance(f, (Column, str))


def expression(f) -> Column:
    """A column or the SQL text of one. Python source is never evaluated."""
    return F.expr(f) if isinstance(f, str) else f


def schema_of(schema, name: str = "value") -> T.StructType:
    """A StructType from one, a data type, or the DDL of either."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is None:
        raise ValueError("a Python function needs the schema of its results")
    return schema if isinstance(schema, T.StructType) else T.StructType([T.StructField(name, schema)])


def elements(batch: pa.RecordBatch) -> list:
    """Elements of a batch: values of a sole column, (key, value) pairs, or rows."""
    names = batch.schema.names
    if len(names) == 1:
        return batch.column(0).to_pylist()
    columns = [c.to_pylist() for c in batch.columns]
    if names == ["key", "value"]:
        return list(zip(*columns, strict=True))
    row = Row(*names)
    return [row(*x) for x in zip(*columns, strict=True)]


def batch_of(items: list, schema: pa.Schema) -> pa.RecordBatch:
    names = schema.names
    if len(names) == 1:
        columns = [items]
    else:
        tuples = [tuple(x[n] for n in names) if isinstance(x, dict) else tuple(x) for x in items]
        columns = [[x[i] for x in tuples] for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Make this package importable by the workers, once an application.

    Only code lies in the driver's temporary folder; Spark sends it to the executors.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="quillon-lib-")) / f"{top.name}.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(packed))


def run_partitions(df: DataFrame, body: Callable[[Iterator, Context], Iterable], schema, functions: Iterable[Function] = (), variables: dict | None = None, barrier: bool = False) -> DataFrame:
    """``body(elements, context)`` over each partition, Arrow batches in and out, between before() and after() of ``functions``."""
    out = schema_of(schema)
    arrow = to_arrow_schema(out, prefers_large_types=False)
    functions = list(functions)
    ship(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = Context(variables)
        started = []
        try:
            for f in functions:
                started.append(f)
                f.before(context)
            held: list = []
            for x in body((e for b in batches for e in elements(b)), context):
                held.append(x)
                if len(held) >= 4096:
                    yield batch_of(held, arrow)
                    held = []
            if held:
                yield batch_of(held, arrow)
        finally:
            for f in started:
                f.after(context)

    return df.mapInArrow(run, out, barrier=barrier)


def pickled(x) -> bytes:
    return pickle.dumps(x, protocol=5)
