"""Giving memory back between tasks.

A Python worker lives on after its task, beside the executor's JVM and other workers, and its
allocators keep what large arrays have left. A tidy task has large blocks taken from the system one by one, which
then go back when they are freed, and returns the rest at its end.
"""

import ctypes
from functools import wraps

import pyarrow as pa


# Fixed values of the C library: its option for the size from which a block is mapped alone, and the size set.
M_MMAP_THRESHOLD = -3
MAPPED_BYTES = 1 << 22


def map_large_blocks() -> None:
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, MAPPED_BYTES)
    except (OSError, AttributeError):  # not this C library
        pass


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(task):
    """A task over batches that gives its memory back when its input ends."""

    @wraps(task)
    def run(batches, *more):
        map_large_blocks()
        yield from task(batches, *more)
        give_back()

    return run
