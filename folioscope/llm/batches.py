"""Arrow batch helpers."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds about ``limit`` bytes of ``column`` (a single longer value stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
