"""Arrow batches in small parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, ``rows`` at most at a time.

    A batch holds up to 10,000 rows; where they are files, Python objects are
    made of a slice only, and what comes of it is sent before the next.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
