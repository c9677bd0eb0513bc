"""Row numbers over a total order without a task that sees every row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

ROWS_PER_RANGE = 200_000


def numbered(df: DataFrame, order: list[Column], name: str = "id", rows: int | None = None) -> DataFrame:
    """df with `name`, 0, 1, 2 ... in the order; a column of that name is replaced, all others are kept.

    Rows are dealt out by range, numbered within their range, and shifted by the number of rows in the ranges before.
    The only unpartitioned window runs over one row a range. rows: how many there are about, which sets the number of
    ranges.
    """
    tag = uuid.uuid4().hex[:8]  # no column of df has these names
    at, n, shift = f"_range_{tag}", f"_n_{tag}", f"_shift_{tag}"
    rows = df.count() if rows is None else rows
    ranges = max(4, min(4096, -(-rows // ROWS_PER_RANGE)))
    dealt = materialize(df.repartitionByRange(ranges, *order).withColumn(at, F.spark_partition_id()), "ordered")
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(at).agg(F.count("*").alias(n)).select(at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift))
    within = F.row_number().over(Window.partitionBy(at).orderBy(*order))
    placed = dealt.withColumn(n, within).join(F.broadcast(shifts), at)  # shifts: at most 4,096 rows
    return placed.withColumn(name, F.col(shift) + F.col(n) - 1).drop(at, n, shift)
