"""Dataset summary for a report page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillsight.operators import profile
from tillsight.plans.holding import MEMORY, held


def summary(frame: DataFrame, hold: str = MEMORY) -> dict[str, DataFrame]:
    """Shape, schema with null counts and display statistics of a dataset, from one pass.

    The pass gives one row per column, which is held as ``hold`` says and is the entry
    "columns"; unpersist that one to release it.
    """
    return profile.sections_of(held(profile.dataset_summary(frame), hold), frame)
