"""Named functions over datasets, for ``call`` and ``void_call``."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path

_functions: dict[str, Callable] = {}


def register(name: str, function: Callable | None = None):
    """Register ``function(data, **params)``; as a decorator if it is left out. Later names replace earlier ones."""
    if function is None:
        return lambda f: register(name, f)
    _functions[name] = function
    return function


def registered() -> list[str]:
    return sorted(_functions)


def call(session, name: str, data=None, **params):
    if name not in _functions:
        raise KeyError(f"no function is registered as {name!r}")
    return _functions[name](session if data is None else data, **params)


def load(session, where: str):
    """What ``path:Name`` names in a Python file (a Function class is instantiated); the file is shipped to the workers."""
    path, _, name = where.rpartition(":")
    file = Path(path)
    if not path or not file.is_file():
        raise ValueError(f"expected path:Name of a Python file, not {where!r}")
    if file.stem not in sys.modules:
        spec = importlib.util.spec_from_file_location(file.stem, file)
        module = importlib.util.module_from_spec(spec)
        sys.modules[file.stem] = module  # by name, so that workers import it from the shipped file
        spec.loader.exec_module(module)
        session.load_library(str(file))
    elif Path(sys.modules[file.stem].__file__ or "").resolve() != file.resolve():
        raise ValueError(f"another module is named {file.stem}")
    found = getattr(sys.modules[file.stem], name)
    return found() if isinstance(found, type) else found


def load_functions(session, path: str) -> list[str]:
    """Register the functions that a Python file lists in its ``__all__``, by their names."""
    names = load(session, f"{path}:__all__")
    for name in names:
        register(name, load(session, f"{path}:{name}"))
    return list(names)
