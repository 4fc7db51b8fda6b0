"""Sorted rows of a task as a stream of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """(key, columns) of each run of rows with the same first `keys` columns (whole numbers), across batches."""
    now, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(new)
        for x, y in zip(start.tolist(), [*start[1:].tolist(), b.num_rows], strict=True):
            key = tuple(int(c[x]) for c in cols[:keys])
            if key != now:
                if parts:
                    yield now, joined(parts)
                now, parts = key, []
            parts.append([c[x:y] for c in cols[keys:]])
    if parts:
        yield now, joined(parts)


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts, strict=True)]
