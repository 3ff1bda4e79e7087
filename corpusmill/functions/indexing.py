"""Dense row numbers and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import written


def with_row_index(df: DataFrame, *order: str, name: str = "line_no", start: int = 0) -> DataFrame:
    """df with its position in the given order, from `start` on.

    Rows are sorted by range over many tasks; each task's first position follows from the task sizes, of
    which there are as many as tasks. Ties are placed in any order, once and for all.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = written(local.withColumn("part__", F.spark_partition_id()).withColumn("at__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = local.groupBy("part__").agg(F.count(F.lit(1)).alias("size__"))
    before = F.coalesce(F.sum("size__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part__", before.alias("before__"))
    index = (F.col("before__") + F.col("at__") + start).cast("bigint")
    return local.join(F.broadcast(offsets), "part__").withColumn(name, index).drop("part__", "at__", "before__")


def with_running_total(keys: DataFrame, group: str, *order: str, size: str, name: str) -> DataFrame:
    """keys with the sum of size over the rows before each in its group, for narrow rows (keys and sizes, not payloads).

    Rows are sorted by range over many tasks, so a group takes as many as it needs; what comes before a task follows from the
    totals by group and task, of which there are as many as groups and tasks together.
    """
    before = lambda *by: Window.partitionBy(group, *by).rowsBetween(Window.unboundedPreceding, -1)
    ranged = written(keys.repartitionByRange(group, *order).withColumn("part__", F.spark_partition_id()))
    totals = ranged.groupBy(group, "part__").agg(F.sum(size).alias("total__"))
    offsets = totals.select(group, "part__", F.coalesce(F.sum("total__").over(before().orderBy("part__")), F.lit(0)).alias("before__"))
    local = F.coalesce(F.sum(size).over(before("part__").orderBy(*order)), F.lit(0))
    found = ranged.withColumn("local__", local).join(offsets, [group, "part__"])
    return found.withColumn(name, (F.col("before__") + F.col("local__")).cast("bigint")).drop("part__", "local__", "before__")
