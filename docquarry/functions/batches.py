"""Arrow batches of bounded size, and workers that keep no free memory. Nothing here knows Spark."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]
#: A batch that goes out has about so many rows or is made of about so many bytes, whichever comes first.
HELD_ROWS, HELD_BYTES = 256, 4 << 20


def slices(batch: pa.RecordBatch, rows: int = HELD_ROWS) -> Batches:
    """The batch in views of few rows, so that Python objects are made of few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function of batches, whose worker hands free memory back when the task is done: it outlives its task."""

    def lean_run(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # only glibc has it

    return lean_run


def files_out(each: Callable[[pa.RecordBatch], Iterator[tuple[str, bytes]]]) -> Callable[[Batches], Batches]:
    """Batches of path and content, for files that are wanted as a table."""

    def run(batches: Batches) -> Batches:
        paths: list[str] = []
        files: list[bytes] = []
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], ["path", "content"])
        for batch in batches:
            for path, content in each(batch):
                paths.append(path)
                files.append(content)
                size += len(content)
                if len(files) >= HELD_ROWS or size >= HELD_BYTES:
                    yield out()
                    paths, files, size = [], [], 0
        yield out()

    return lean(run)
