"""Ranks and positions that never sort a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import cut


def rank_by(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows with their rank.  Only ``k`` rows reach the final window."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The rank filter becomes a group limit ahead of the exchange, so a hot key
    ships at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Dense 1-based numbers within ``group``, safe for a group of any size.

    Rows are range-partitioned on (group, order), the layout is written once,
    and each row gets its number within its slice plus the sizes of the earlier
    slices of its group.  ``order`` must end in a unique column.
    """
    keys = [*group, *order]
    sliced = df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id())
    sliced = cut(sliced, "slices")
    sizes = sliced.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))  # one row per slice
    within = Window.partitionBy("_slice", *group).orderBy(*order)
    rows = sliced.withColumn("_rank", F.row_number().over(within))
    return (rows.join(offsets.drop("_size"), ["_slice", *group])
            .withColumn(name, (F.col("_rank") + F.col("_before")).cast("bigint")).drop("_slice", "_rank", "_before"))
