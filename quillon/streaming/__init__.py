"""The row-wise operators over streams.

The relational model is bounded, so this only carries filters and projections
over to streaming DataFrames, and a running SUM by key with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import project, select_pipe
from ..functions.arithmetic import arithmetic
from ..plans.binder import Scope
from ..plans.parser import parse_expression

__all__ = ["project", "select_pipe", "windowed_sum"]


def windowed_sum(rows: DataFrame, time: str, width: str, late: str, keys: list[str], function: str) -> DataFrame:
    """SUM of a function by keys and tumbling event-time windows; rows later than ``late`` are dropped."""
    column, _ = arithmetic(parse_expression(function), Scope([rows]))
    timed = rows.withColumn("_value", column).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.sum("_value").alias("sum"))
