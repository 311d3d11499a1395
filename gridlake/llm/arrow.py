"""Small helpers shared by the Arrow kernels of this folder."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# executors need not have this package installed: kernels travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def texts(column: pa.Array) -> list[str]:
    """Values of a string column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


#: rows in a batch at most, so that a row number in it fits 16 bits
ROWS = 1 << 14


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        start, size = 0, 0
        lengths = batch.column(column).cast(pa.large_binary())
        for i in range(batch.num_rows):
            n = len(lengths[i].as_buffer()) if lengths[i].is_valid else 0
            if i > start and (size + n > most or i - start == ROWS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next stage's needs are others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has its own policy


def forget() -> None:
    """Drop what kernels of other operators remember in this worker, before one that needs the room."""
    for name, module in list(sys.modules.items()):
        if name.startswith("_gridlake_memo_"):
            module.__dict__["memo"].clear()
    give_back()


def process_memo(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, across tasks."""
    module = sys.modules.setdefault(f"_gridlake_memo_{name}", types.ModuleType(name))
    return module.__dict__.setdefault("memo", {})
