"""Arrow batches of large values, some rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a batch that are looked at together; a larger row stands alone.
BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], *names: str, most: int = BYTES) -> Iterator[list[pa.Array]]:
    """The named columns of all batches, about ``most`` bytes at a time, so that their Python values never stand in memory together."""
    for b in batches:
        rows = max(1, min(b.num_rows, most * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            yield [part.column(n) for n in names]
