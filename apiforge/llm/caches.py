"""One lookup cache at a time in a Python worker.

Spark reuses worker processes from stage to stage; a cache that a later stage does
not use would only take memory beside that stage's own.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_HELD: dict = {}


def only(name, make):
    """The cache of this name, made on first use; all others are dropped, and their memory goes back to the system."""
    held = _HELD.get(name)
    if held is None:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc
        if trim:
            trim(0)
        held = _HELD[name] = make()
    return held
