"""Global order without a single task: range partitions, sums within each, and a base for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.storage import written


def prefix_sums(df: DataFrame, group: list[str], order: list[str], length: str, name: str = "offset") -> DataFrame:
    """df with the sum of ``length`` over the earlier rows of its group, in order.

    Rows are range-partitioned by group and order, so a group of any size is many partitions; the
    window runs within one partition of one group, and the groups' partition totals, one row each, are
    summed up apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    local = F.sum(length).over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = placed.groupBy(*group, "_part").agg(F.sum(length).alias("_n"))
    base = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(*group, "_part", F.coalesce(base, F.lit(0)).alias("_base"))
    return placed.withColumn("_local", F.coalesce(local, F.lit(0))).join(bases, [*group, "_part"]).withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_part", "_local", "_base")


def numbered(df: DataFrame, order: list[str], name: str = "file_ord") -> DataFrame:
    return prefix_sums(df.withColumns({"_one": F.lit(1), "_all": F.lit(0)}), ["_all"], order, "_one", name).drop("_one", "_all")


def largest(df: DataFrame, group: str, n: int, size: str, tie: str) -> DataFrame:
    """The n largest rows of each group; Spark prunes to n a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(size), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
