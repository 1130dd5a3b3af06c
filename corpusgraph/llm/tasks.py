"""What functions over Arrow batches share."""

import ctypes
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def lean(function):
    """The same function of batches; at its end the worker gives free memory back.

    Spark keeps Python workers for later tasks, and what they hold counts against the executor.
    """
    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()
    return run


@contextmanager
def giving_back():
    """:func:`lean` for a block of code: free memory goes back at its end."""
    try:
        yield
    finally:
        _give_back()
