"""Places within groups without a task that holds a whole group.

Rows are dealt by ranges of (group, order) and numbered within each range; the sizes of the ranges before it are then
added. A group with a third of all rows is spread over as many ranges as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranked(df: DataFrame, group: str | None, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 1, and ``group_size``; the order must be total. The ranges are written, so that both reads see the same."""
    keys = {f"_o{i}": c for i, c in enumerate(order)} | {"_group": F.col(group) if group else F.lit(0)}
    keyed = df.withColumns(keys)
    spread = cut(keyed.repartitionByRange("_group", *[f"_o{i}" for i in range(len(order))]).withColumn("_part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*[f"_o{i}" for i in range(len(order))]))
    of_group = Window.partitionBy("_group")
    counts = spread.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_group").alias("_g2"), F.col("_part").alias("_p2"), before.alias("_before"), F.sum("_n").over(of_group).alias("group_size"))
    out = spread.withColumn("_local", local).join(offsets, F.col("_group").eqNullSafe(F.col("_g2")) & (F.col("_part") == F.col("_p2")))
    return out.withColumn(name, F.col("_local") + F.col("_before")).drop("_group", "_part", "_local", "_g2", "_p2", "_before", *[f"_o{i}" for i in range(len(order))])
