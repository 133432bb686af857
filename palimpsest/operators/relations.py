"""Merges of keyed sets, intervals, chains and places in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copy_missing(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of source whose key target lacks."""
    return source.join(target.select(*key).distinct(), key, "left_anti")


def dangling(refs: DataFrame, ref: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows that refer to an id that is not there; a null refers to nothing."""
    return refs.where(F.col(ref).isNotNull()).join(ids.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def overlapping(segments: DataFrame, ranges: DataFrame, key: str, start: str, end: str, r_start: str, r_end: str, width: int) -> DataFrame:
    """Segments and ranges of a key that overlap, by an equi-join on the grid cells (width wide) that either touches.

    Each pair is kept in the cell where its overlap begins, so it appears once.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = segments.where(F.col(end) > F.col(start)).withColumn("__cell", cells(start, end))
    b = ranges.where(F.col(r_end) > F.col(r_start)).withColumn("__cell", cells(r_start, r_end))
    met = a.join(b, [key, "__cell"]).where((F.col(start) < F.col(r_end)) & (F.col(r_start) < F.col(end)))
    return met.where(F.floor(F.greatest(start, r_start) / width) == F.col("__cell")).drop("__cell")


def locate_in_context(text: Column, before: Column, needle: Column, widths: tuple[int, ...] = (40, 20, 10, 0)) -> Column:
    """1-based place of needle in text, looked for with the longest tail of `before` that still finds it; 0 if nowhere."""
    tries = []
    for n in widths:
        tail = F.right(before, F.lit(n)) if n else F.lit("")
        at = F.instr(text, F.concat(tail, needle))
        tries.append(F.when(at > 0, at + F.length(tail)))
    return F.coalesce(*tries, F.lit(0))


def resolve_chains(parents: DataFrame, child: str, parent: str, most: int = 11) -> DataFrame:
    """(node, root, depth): follows parents up to `most` steps; a node without a known parent is its own root."""
    edges = parents.select(F.col(child).alias("node"), F.col(parent).alias("up"))
    now = edges.select("node", F.col("node").alias("root"), F.col("up"), F.lit(0).alias("depth"))
    steps = edges.select(F.col("node").alias("up"), F.col("up").alias("further"))
    for _ in range(most):
        now = now.join(steps, "up", "left").select(
            "node", F.coalesce("up", "root").alias("root"), F.col("further").alias("up"), (F.col("depth") + F.col("up").isNotNull().cast("int")).alias("depth")
        )
    return now.select("node", "root", "depth")


def map_difference(old: Column, new: Column) -> Column:
    """Sorted names that only one map has or whose values differ; a null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(zipped, lambda k, v: v)))
