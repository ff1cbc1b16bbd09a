"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import materialize

#: Rows of a range; they are narrow (a few numbers or digests).
RANGE_ROWS = 200_000


def placed(df: DataFrame, order: list[str | Column], group: str | None = None) -> DataFrame:
    """`df` plus _place (from 0, in `order`, within each value of `group`) and _of, the number of rows of that value.

    Null is a value of `group`, by which `order` must begin. Rows are range-sorted, so that a value that holds most rows
    lies in many ranges; where a value begins in a range follows from counts (a row for each value and range). The ranges
    are written once, so that their numbers never change.
    """
    parts = df.count() // RANGE_ROWS + 1
    q = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    groups = [] if group is None else [group]
    sizes = q.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy(*groups)
    ahead = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias("_g") for g in groups],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"),
        F.sum("_n").over(of).alias("_of"),
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col("_g"))
    q = q.withColumn("_in", inside).join(sizes, same).withColumn("_place", F.col("_start") + F.col("_in") - 1)
    return q.drop("_part", "_p", "_g", "_start", "_in")
