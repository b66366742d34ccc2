"""Python workers that give back what a task held, rather than keep it while they wait for the next task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: mallopt's parameter for the size from which a block is mapped on its own and so returned when freed, and that size.
MMAP_THRESHOLD, MAPPED_BYTES = -3, 256 << 10


def _c_library() -> ctypes.CDLL | None:
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") else None  # not glibc: nothing to tune


def lean(work: Work) -> Work:
    """``work`` for mapInArrow, with memory returned to the system when a partition ends.

    Executors keep their Python workers, of which a task may use several; without this each would hold on to the most memory that
    any stage before has taken in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _c_library()
        if library is not None:
            library.mallopt(MMAP_THRESHOLD, MAPPED_BYTES)
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if library is not None:
                library.malloc_trim(0)

    return run
