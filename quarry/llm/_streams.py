"""Helpers of tasks that read record batches."""

from __future__ import annotations


def groups(batches, width: int):
    """(key, rows) of each run of rows with equal first `width` columns; rows hold the other columns.

    The rows must be sorted by those columns; a group may go over any number of batches.
    """
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def pieces(batches, rows: int = 1000):
    """The batches in slices of at most `rows` rows, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
