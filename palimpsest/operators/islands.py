"""Grouping of neighbouring rows with equal keys, running offsets and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_adjacent(df: DataFrame, partition: list[str], order: list[str], key: str, name: str = "group_no") -> DataFrame:
    """Numbers the maximal runs of equal keys within a partition, from 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    begins = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__begins", begins)
    return marked.withColumn(name, F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__begins")


def running_offset(df: DataFrame, partition: list[str], order: list[str], width: Column, name: str) -> DataFrame:
    """Where each row's stretch of the given width begins when a partition's rows are laid end to end."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(width).over(w), F.lit(0)))


def renumber(df: DataFrame, partition: list[str], order: list[str], name: str) -> DataFrame:
    """Dense numbers from 1 within a partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def rank_by_table(df: DataFrame, key: str, ranks: dict[str, int], partition: list[str], then: list[str], name: str) -> DataFrame:
    """Numbers rows by a table of ranks (keys that it lacks come last), rows of one rank by `then`."""
    listed = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    rank = F.coalesce(F.try_element_at(listed, F.col(key)), F.lit(len(ranks)))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(rank, *then)))
