"""The first rows of a global order, and their number, without bringing rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, from 0, in the order of columns: partitions by range, each sorted for itself; a row's place is that
    within its partition and the count of the partitions before. rows are kept while both are read."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = parted.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")).persist()
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_id").bitwiseAND((1 << 33) - 1)
    return marked.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + within).drop("_part", "_id", "_before")
