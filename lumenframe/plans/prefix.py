"""Global running sums without a single-task window: range partitions, one offset a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.plans.staging import Staged


def running_sums(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Adds, for each new name, the sum of a column over all rows up to and with the row, in a total order."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held = Staged(ranged, "ranged").df
    sums = held.groupBy("_part").agg(*(F.sum(v).alias(f"_s_{k}") for k, v in values.items()))
    before = Window.orderBy("_part")
    offsets = sums.select("_part", *((F.sum(f"_s_{k}").over(before) - F.col(f"_s_{k}")).alias(f"_o_{k}") for k in values))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({k: F.sum(v).over(inner) for k, v in values.items()}).join(F.broadcast(offsets), "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in values}).drop("_part", *(f"_o_{k}" for k in values))
