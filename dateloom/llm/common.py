"""What the operators share: the library's tables and joins, and tasks that give memory back."""

from __future__ import annotations

from dateloom.tables import BROADCAST_ROWS, scratch, small, spread, table, tune, written

__all__ = ["BROADCAST_ROWS", "frugal", "remembered", "scratch", "small", "spread", "table", "tune", "written"]

#: Functions reach the workers by value, so what a worker keeps between tasks hangs on a module of this name there.
_KEPT = "_dateloom_kept"


def remembered(key, make):
    """What make() gives, made once in this worker process and kept for later tasks that are `frugal(..., remembers=True)`.

    One key is kept at a time; any task that remembers nothing lets it go.
    """
    import sys
    import types

    held = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT))
    if getattr(held, "key", None) != key:
        held.value = None
        held.key, held.value = key, make()
    return held.value


def forget() -> None:
    """Lets go what this worker process remembers."""
    import sys

    sys.modules.pop(_KEPT, None)


def frugal(run, remembers: bool = False):
    """run, a generator over Arrow batches, followed by the return of freed memory to the system: workers live on and
    would else hold the most that any of their tasks has needed. remembers: the task uses `remembered`."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow

        if not remembers:
            forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
