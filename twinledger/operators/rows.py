"""Small helpers for one-row results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Several one-row frames as one row, by union and ``max`` instead of a join without keys."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(F.col(c)).alias(c) for c in stacked.columns])
