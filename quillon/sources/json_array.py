"""Folders of part files that are one JSON array each."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.callables import run_partitions
from .text import by_file


def partition_json_file(session, path: str, element: str = "variant") -> Dataset:
    """Elements as ``element`` (DDL); as variants unless a type is given. Objects and scalars alike.

    A partition for each file, in the order of their names. A file is one array
    and so one task's work, 2 GB at most.
    """
    whole = by_file(session.spark.read.text(path, wholetext=True), "value")
    return Dataset(whole.select(F.explode(F.from_json("value", f"array<{element}>")).alias("value")), session)


def save(data: Dataset, path: str, pretty: bool = True, overwrite: bool = False) -> None:
    """An array a partition, indented by four if ``pretty``; written by Spark's text writer, so on any file system."""
    cols = data.df.columns
    element = F.to_json(F.struct(F.col(cols[0]).alias("value"))) if len(cols) == 1 else F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    single = len(cols) == 1

    def body(items, _):
        first = True
        for text in items:
            x = json.loads(text)
            x = x.get("value") if single else x
            shown = json.dumps(x, indent=4 if pretty else None, ensure_ascii=False)
            if pretty:
                shown = "\n".join("    " + line for line in shown.split("\n"))
            yield ("[" if first else ",") + ("\n" if pretty else "") + shown
            first = False
        yield ("[" if first else "") + ("\n" if pretty else "") + "]"

    lines = run_partitions(data.df.select(element.alias("value")), body, "value string")
    lines.write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").text(path)
