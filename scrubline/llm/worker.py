"""What a Python worker process keeps between tasks: one object, of the operator that used the process last.

Worker processes outlive stages. A vocabulary, an automaton or a memo is costly to build for every task, but kept by
every operator they would add up in one process; so a new owner releases what the one before it held.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def release() -> None:
    """Drops what is held and hands freed pages back to the system."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The object of this key; the first call, or one after another key's, makes it."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]
