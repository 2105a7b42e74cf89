"""Global ranks and running sums without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows that are numbered together where rows have a dense key.
BLOCK = 4096


def ranked(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with ``rank``, from 0, in that order: a range partitioning, a sort inside partitions, and the
    partitions' sizes added up. The sorted rows are stored, so the numbering is taken from one and the same run.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(cut.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_at") - F.col("_first") + F.col("_start")).drop("_part", "_at", "_first", "_start")


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """df with a column for each of values: its sum over the rows before this one, in order of a dense number.

    Rows are summed inside blocks of the number; a block starts with the sum of the blocks before it.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / BLOCK).cast("long"))
    per = rows.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*keys, "_block", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in values])
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{k}") for k, v in values.items()])
    out = rows.join(starts, [*keys, "_block"])
    return out.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_start_{k}")).cast("long").alias(k) for k in values])
