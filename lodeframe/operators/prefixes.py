"""Joins of strings with a table of prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def prefix_join(rows: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row of rows with each row of prefixes whose prefix its key begins with.

    Both sides may grow: a key is cut to the lengths that prefixes have, so the two meet in an equi-join on the string and
    no pair is tried that does not match. Lengths are one sorted array, no longer than the longest prefix. Nulls meet
    nothing; an empty prefix meets every key.
    """
    lengths = prefixes.filter(F.col(prefix).isNotNull()).agg(F.array_sort(F.collect_set(F.length(prefix))).alias("lengths"))
    fitting = F.filter(F.col("_lengths"), lambda n: n <= F.length(key))
    cut = rows.withColumn("_lengths", lengths.scalar()).withColumn("_n", F.explode(fitting)).withColumn("_cut", F.substring(F.col(key), F.lit(1), F.col("_n"))).drop("_lengths", "_n")
    return cut.join(prefixes, F.col("_cut") == F.col(prefix)).drop("_cut")
