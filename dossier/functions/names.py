"""Names for columns that a function adds for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(*frames: DataFrame) -> str:
    """A prefix with which no column of the frames begins, in any case of letters."""
    taken = tuple(c.lower() for frame in frames for c in frame.columns)
    prefix = "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix
