"""Session and properties."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, MutableMapping

from pyspark.sql import SparkSession

_UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5, "E": 6, "Z": 7, "Y": 8}


def parse_size(text: str | int) -> int:
    """Bytes of ``10MB``, ``1GiB`` (powers of 1024), ``8Kb`` (bits), with ``,`` or ``.`` for decimals."""
    m = re.fullmatch(r"\s*(\d+(?:[.,]\d+)?)\s*([KMGTPEZY]?)(i?)([Bb]?)\s*", str(text))
    if not m:
        raise ValueError(f"not a size: {text!r}")
    number = float(m[1].replace(",", ".")) * (1024 if m[3] else 1000) ** _UNITS[m[2]]
    return int(number / 8 if m[4] == "b" else number)


def parse_bool(text: str | bool) -> bool:
    """True for words that begin with y, t or 1, false for n, f or 0."""
    word = str(text).strip().lower()
    if word[:1] in ("y", "t", "1"):
        return True
    if word[:1] in ("n", "f", "0"):
        return False
    raise ValueError(f"not a truth value: {text!r}")


class Properties(MutableMapping):
    """String properties with text persistence (one ``key=value`` a line) and JSON maps."""

    def __init__(self, values: dict | None = None):
        self._values: dict[str, str] = {str(k): str(v) for k, v in (values or {}).items()}

    def __getitem__(self, key: str) -> str:
        return self._values[key]

    def __setitem__(self, key: str, value) -> None:
        self._values[key] = str(value)

    def __delitem__(self, key: str) -> None:
        del self._values[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def size(self, key: str) -> int:
        return parse_size(self[key])

    def flag(self, key: str) -> bool:
        return parse_bool(self[key])

    def to_map(self) -> dict[str, str]:
        return dict(self._values)

    @classmethod
    def from_map(cls, values: dict) -> Properties:
        return cls(values)

    def to_json(self) -> str:
        return json.dumps(self._values, sort_keys=True)

    def store(self, path: str) -> None:
        with open(path, "w") as f:
            f.writelines(f"{k}={v}\n" for k, v in sorted(self._values.items()))

    def load(self, path: str) -> None:
        with open(path) as f:
            for line in f:
                if line.strip() and not line.lstrip().startswith("#"):
                    key, _, value = line.rstrip("\n").partition("=")
                    self[key.strip()] = value.strip()


class Session:
    """A SparkSession with its properties and registered functions. ``start`` twice is one session."""

    _current: Session | None = None

    def __init__(self, spark: SparkSession, properties: Properties | None = None):
        self.spark = spark
        self.properties = properties or Properties()
        self.variables: dict = {}

    @classmethod
    def start(cls, properties: Properties | None = None, name: str = "quillon") -> Session:
        if cls._current is None:
            builder = SparkSession.builder.appName(name)
            for k, v in (properties or {}).items():
                if k.startswith("spark."):
                    builder = builder.config(k, v)
            cls._current = cls(builder.getOrCreate(), properties)
        return cls._current

    @classmethod
    def of(cls, spark: SparkSession) -> Session:
        return cls(spark)

    def stop(self) -> None:
        self.spark.stop()
        Session._current = None

    def send_file(self, path: str, archive: bool = False) -> None:
        """Ship a file, or an archive that is unpacked, to every executor."""
        context = self.spark.sparkContext
        (context.addArchive if archive else context.addFile)(path)

    def load_library(self, path: str) -> None:
        """Make a Python file or zip importable by user functions."""
        self.spark.sparkContext.addPyFile(path)

    def executors(self) -> int:
        """Executors of the application; a local one counts as one."""
        n = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
        return max(1, n - 1)

    # -- sources, kept in their own modules

    def parallelize(self, data, partitions: int | None = None, schema=None, src=None):
        from .sources.memory import parallelize

        return parallelize(self, data, partitions, schema).prepared(src)

    def execute_to(self, function, partitions: int, schema):
        from .sources.memory import execute_to

        return execute_to(self, function, partitions, schema)

    def execute(self, function, tasks: int | None = None) -> None:
        from .sources.memory import execute

        execute(self, function, tasks)

    def run_command(self, *command: str, tasks: int | None = None) -> None:
        """Run a program once in each of so many tasks (one for each executor) at the same time; a failing one is an error."""
        import subprocess

        self.execute(lambda _: subprocess.run(command, check=True), tasks)

    def import_dataset(self, data):
        """The dataset as one of this session: partitions are already shared."""
        from .dataset import Dataset

        return Dataset(data.df, self)

    def table(self, path: str):
        from .dataset import Dataset

        return Dataset(self.spark.read.parquet(path), self)

    def text_file(self, path: str, min_partitions: int = 1):
        from .sources.text import text_file

        return text_file(self, path, min_partitions)

    def plain_file(self, path: str, min_partitions: int = 1, delim: str = "\n"):
        from .sources.text import plain_file

        return plain_file(self, path, min_partitions, delim)

    def partition_text_file(self, path: str):
        from .sources.text import partition_text_file

        return partition_text_file(self, path)

    def partition_json_file(self, path: str, element: str = "variant"):
        from .sources.json_array import partition_json_file

        return partition_json_file(self, path, element)

    def partition_object_file(self, path: str):
        from .sources.objects import partition_object_file

        return partition_object_file(self, path)

    def call(self, name: str, data=None, **params):
        """A registered function from dataset (or session) and parameters to a dataset."""
        from .functions.registry import call

        return call(self, name, data, **params)

    def load_function(self, where: str):
        """The function or Function that ``path:Name`` names."""
        from .functions.registry import load

        return load(self, where)

    def load_functions(self, path: str) -> list[str]:
        """Register what a Python file lists in ``__all__`` for ``call`` and ``void_call``."""
        from .functions.registry import load_functions

        return load_functions(self, path)

    def void_call(self, name: str, data=None, **params) -> None:
        from .functions.registry import call

        call(self, name, data, **params)
