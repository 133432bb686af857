"""Splitting pairs of texts at their correlated runs, level by level, so that only what lies between reaches a kernel.

A window is a stretch of lines on each side of a pair. Where both have three lines or more, the common run of most
characters splits it if it is large enough; what is before and after it are windows of the next level. All maximal
runs of a pair are found once, by a join on digests; a level clips them to its windows and takes the best of each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import diff
from palimpsest.sources.scratch import dealt, written

KEY = ["a_id", "b_id"]
WINDOW = [*KEY, "i0", "i1", "j0", "j1"]


def weighed_runs(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, i, d, upto): the maximal common runs: start in a, diagonal i - j, running sums of its lines' weights from 0."""
    ids = pairs.select(*KEY)
    held = hashed.select("doc_id", "line_no", F.xxhash64("h").alias("h1"), F.xxhash64("h", F.lit(1)).alias("h2"), (F.length("line") + 1).cast("long").alias("w"))
    a = ids.join(held.select(F.col("doc_id").alias("a_id"), F.col("line_no").alias("i"), "h1", "h2", "w"), "a_id")
    b = ids.join(held.select(F.col("doc_id").alias("b_id"), F.col("line_no").alias("j"), "h1", "h2"), "b_id")
    met = a.join(b, [*KEY, "h1", "h2"]).select(*KEY, "i", (F.col("i") - F.col("j")).alias("d"), "w")
    along = Window.partitionBy(*KEY, "d").orderBy("i")
    met = met.withColumn("island", F.col("i") - F.row_number().over(along))
    # sums are made from the window's start on, so that a run of thousands of lines stays linear
    met = met.withColumn("sum", F.sum("w").over(along))
    runs = met.groupBy(*KEY, "d", "island").agg(F.min("i").alias("i"), F.min(F.col("sum") - F.col("w")).alias("base"), F.array_sort(F.collect_list("sum")).alias("sums"))
    return runs.select(*KEY, "i", "d", F.concat(F.array(F.lit(0).cast("long")), F.transform("sums", lambda s: s - F.col("base"))).alias("upto"))


def large_enough(n: Column, atoms: Column) -> Column:
    return (n > diff.MANY_UNITS) | ((n > 1) & (atoms > diff.ATOMS_OF_FEW)) | ((n == 1) & (atoms > diff.ATOMS_OF_ONE))


def correlated_windows(pairs: DataFrame, hashed: DataFrame, piece: int = 0) -> DataFrame:
    """(a_id, b_id, i0, i1, j0, j1, matched): every line of both sides once, in matched runs and in windows between them.

    Windows of no more than `piece` lines in all are left as they are. Pairs of which one side has no lines are one
    window; lines are those of `hashed`, numbered from 0.
    """
    size = hashed.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    side = lambda c, n: size.select(F.col("doc_id").alias(c), F.col("n").alias(n))
    whole = pairs.select(*KEY).join(side("a_id", "i1"), "a_id", "left").join(side("b_id", "j1"), "b_id", "left").na.fill(0, ["i1", "j1"])
    whole = whole.select(*KEY, F.lit(0).alias("i0"), "i1", F.lit(0).alias("j0"), "j1")
    splits = (F.least(F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0")) >= diff.LEAST_UNITS) & (F.col("i1") - F.col("i0") + F.col("j1") - F.col("j0") > piece)
    open_ = written(whole, "windows")
    runs = written(weighed_runs(open_.where(splits), hashed), "window-runs")
    found = []
    while True:
        found.append(open_.where(~splits).withColumn("matched", F.lit(False)))
        open_ = open_.where(splits)
        first = F.greatest(F.col("i"), F.col("i0"), F.col("j0") + F.col("d"))
        last = F.least(F.col("i") + F.size("upto") - 1, F.col("i1"), F.col("j1") + F.col("d"))
        clipped = open_.join(runs, KEY).withColumn("s", first).withColumn("e", last).where("s < e")
        atoms = F.element_at("upto", F.col("e") - F.col("i") + 1) - F.element_at("upto", F.col("s") - F.col("i") + 1)
        best = clipped.groupBy(*WINDOW).agg(F.max(F.struct(atoms.alias("atoms"), (-F.col("s")).alias("s"), (F.col("d") - F.col("s")).alias("t"), (F.col("e") - F.col("s")).alias("n"))).alias("r"))
        best = best.where(large_enough(F.col("r.n"), F.col("r.atoms"))).select(*WINDOW, (-F.col("r.s")).alias("i"), (-F.col("r.t")).alias("j"), F.col("r.n").alias("n"))
        level = written(open_.join(best, WINDOW, "left"), "window-level")
        found.append(level.where("n is null").select(*WINDOW, F.lit(False).alias("matched")))
        split = level.where("n is not null")
        if not split.take(1):
            break
        window = lambda i0, i1, j0, j1: split.selectExpr(*KEY, f"{i0} as i0", f"{i1} as i1", f"{j0} as j0", f"{j1} as j1")
        found.append(window("i", "i + n", "j", "j + n").withColumn("matched", F.lit(True)))
        open_ = window("i0", "i", "j0", "j").union(window("i + n", "i1", "j + n", "j1")).where("i0 < i1 or j0 < j1")
    return reduce(DataFrame.union, found)


def _side(pieces: DataFrame, lines: DataFrame, key: str, low: str, high: str, name: str) -> DataFrame:
    at = pieces.where(f"{low} < {high}").select(*WINDOW, F.explode(F.sequence(F.col(low), F.col(high) - 1)).alias("line_no"))
    held = at.join(lines.select(F.col("doc_id").alias(key), "line_no", "line"), [key, "line_no"])
    return held.groupBy(*WINDOW).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias(name))


def diff_in_pieces(pairs: DataFrame, hashed: DataFrame, detail: bool, piece: int) -> DataFrame:
    """As diff.diff(), with the windows between correlated runs dealt to tasks one by one."""
    pieces = written(correlated_windows(pairs, hashed, piece), "diff-pieces")
    full = pieces.join(_side(pieces, hashed, "a_id", "i0", "i1", "la"), WINDOW, "left").join(_side(pieces.where("not matched"), hashed, "b_id", "j0", "j1", "lb"), WINDOW, "left")
    full = dealt(full.select(*KEY, "i0", "j0", "matched", "la", "lb"), *KEY, "i0", "j0")
    rows = full.mapInArrow(diff.piece_diff(detail), "a_id long, b_id long, i0 int, j0 int, k int, status string, text string")
    # neighbours of one status, of two pieces too, are one stretch
    order = Window.partitionBy(*KEY).orderBy("i0", "j0", "k")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("new", F.when(F.lag("status").over(order) == F.col("status"), 0).otherwise(1))
    rows = rows.withColumn("seq_no", (F.sum("new").over(order) - 1).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return rows.groupBy(*KEY, "seq_no", "status").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).select(*KEY, "seq_no", "status", "text")


def promote_skip_ahead(rows: DataFrame, most: int = 3) -> DataFrame:
    """Turns equal lines that follow a deleted stretch into an insertion before it and a deletion after it, to become a move.

    rows: a_id, b_id, seq_no, status, i, j, in_table, a line each, in order. It holds for the first equal lines after
    deleted ones, up to the first line of a table, if that is among the first `most`; and only where what stands before
    the deleted stretch, once earlier ones are turned, is equal or inserted, or nothing.
    """
    order = Window.partitionBy(*KEY).orderBy("seq_no")
    rows = rows.withColumn("__new", F.when(F.lag("status").over(order).eqNullSafe(F.col("status")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("__new").over(order)).drop("__new")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY, "run").orderBy("seq_no")))
    runs = rows.groupBy(*KEY, "run").agg(F.first("status").alias("kind"), F.count("*").alias("n"), F.min(F.when(F.col("in_table"), F.col("rank"))).alias("table"))
    along = Window.partitionBy(*KEY).orderBy("run")
    beside = {"before": F.lag("kind"), "after": F.lead("kind"), "taken": F.lead("table"), "there": F.lead("n")}
    runs = runs.select(*KEY, "run", "kind", *[c.over(along).alias(name) for name, c in beside.items()])
    fits = runs.where(f"kind = 'Deleted' and after = 'Equal' and taken <= {most} and (before is null or before in ('Equal', 'Inserted'))")
    # a stretch right behind a turned one has a deletion before it: of a chain of such stretches every other one turns
    linked = (F.lag("run").over(along) == F.col("run") - 2) & F.lag(F.col("taken") == F.col("there")).over(along)
    fits = fits.withColumn("__begins", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("__begins").over(along))
    place = F.row_number().over(Window.partitionBy(*KEY, "chain").orderBy("run"))
    turned = fits.withColumn("place", place).where("place % 2 = 1").select(*KEY, (F.col("run") + 1).alias("run"), "taken")
    rows = rows.join(turned, [*KEY, "run"], "left")
    null = F.lit(None).cast("int")
    version = lambda run, part, status, i, j: F.struct(run.alias("run"), F.lit(part).alias("part"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), i.alias("i"), j.alias("j"))
    both = F.array(version(F.col("run") - 1, 0, "Inserted", null, F.col("j")), version(F.col("run") - 1, 2, "Deleted", F.col("i"), null))
    same = F.array(version(F.col("run"), 1, F.col("status"), F.col("i"), F.col("j")))
    out = rows.select(*KEY, "rank", "in_table", F.explode(F.when(F.col("rank") <= F.col("taken"), both).otherwise(same)).alias("v")).select(*KEY, "rank", "in_table", "v.*")
    return out.withColumn("seq_no", F.row_number().over(Window.partitionBy(*KEY).orderBy("run", "part", "rank")) - 1).select(*KEY, "seq_no", "status", "i", "j", "in_table")


def turned_runs(kinds: list[str], in_table, most: int = 3) -> list[tuple[int, int]]:
    """(number of a run of equal lines, how many of its first lines are turned): as promote_skip_ahead(), of one pair's runs in order.

    in_table: from a run's number to whether each of its lines is one of a table.
    """
    out, linked = [], None  # the run that a chain goes on with, and whether the one before it turned
    for k in range(len(kinds) - 1):
        if kinds[k] != "Deleted" or kinds[k + 1] != "Equal" or (k and kinds[k - 1] not in ("Equal", "Inserted")):
            continue
        lines = [*in_table(k + 1)]
        n = lines.index(True) + 1 if True in lines else most + 1
        if n <= most:
            turns = not (linked and linked[0] == k and linked[1])
            if turns:
                out.append((k + 1, n))
            linked = (k + 2, turns) if n == len(lines) else None
    return out
