"""Name search over names that keep arriving: the score is a native expression, so a stream needs no state for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeframe.functions.fuzzy import fuzzy_score
from lodeframe.operators.rank import tier


def scored_stream(names: DataFrame, name: str, query: str) -> DataFrame:
    """Rows of a stream (or a table) that query hits, with tier and score, as they arrive."""
    ranked = names.withColumn("tier", tier(F.col(name), query)).withColumn("score", fuzzy_score(query, F.col(name)))
    return ranked.filter("tier < 3 or score is not null")


def first_seen(names: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first row of each key in a stream; keys are remembered until the watermark passes them."""
    return names.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
