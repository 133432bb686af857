"""Set-based alignment of document pairs: joins on line digests, diagonals, positions and occurrences.

All take pairs (a_id, b_id) and hashed lines (doc_id, line_no, line, h); a pair's two sides are joined in, never all
pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def sides(pairs: DataFrame, hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of each side: (a_id, b_id, i, ha, line_a) and (a_id, b_id, j, hb, line_b)."""
    ids = pairs.select("a_id", "b_id")
    a = ids.join(hashed.select(F.col("doc_id").alias("a_id"), F.col("line_no").alias("i"), F.col("h").alias("ha"), F.col("line").alias("line_a")), "a_id")
    b = ids.join(hashed.select(F.col("doc_id").alias("b_id"), F.col("line_no").alias("j"), F.col("h").alias("hb"), F.col("line").alias("line_b")), "b_id")
    return a.select("a_id", "b_id", "i", "ha", "line_a"), b.select("a_id", "b_id", "j", "hb", "line_b")


def lines_beside(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, la, lb): a pair a row, with the lines (line_no, line) of both sides in order; both have any."""
    held = hashed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return beside(pairs, held, "l")


def beside(pairs: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """(a_id, b_id, and the column of both sides, with a and b behind its name): a pair a row, in as many tasks as the session shuffles to.

    Documents are shuffled once, and those of a once more to those of b; what then reads a pair does so where it lies.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda k: docs.select(F.col("doc_id").alias(f"{k}_id"), F.col(column).alias(f"{column}{k}"))
    # a count of its own keeps partitions that are small in bytes apart, and a sorted join lets no side be broadcast
    a = pairs.select("a_id", "b_id").join(side("a"), "a_id").repartition(n, "b_id")
    return a.hint("merge").join(side("b"), "b_id").select("a_id", "b_id", f"{column}a", f"{column}b")


def status(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), "Equal").when(a.isNotNull(), "Deleted").otherwise("Inserted")


def diff_by_occurrence(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, status, n): lines as a multiset; the k-th copy on one side meets the k-th on the other.

    Only counts matter: of a line's copies as many are Equal as both sides have, the rest is Deleted or Inserted.
    """
    held = hashed.groupBy("doc_id", F.xxhash64("h").alias("h1"), F.xxhash64("h", F.lit(1)).alias("h2")).agg(F.count("*").alias("n"))
    a = pairs.select("a_id", "b_id").join(held.withColumnRenamed("doc_id", "a_id"), "a_id").select("a_id", "b_id", "h1", "h2", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"))
    b = pairs.select("a_id", "b_id").join(held.withColumnRenamed("doc_id", "b_id"), "b_id").select("a_id", "b_id", "h1", "h2", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"))
    lines = a.union(b).groupBy("a_id", "b_id", "h1", "h2").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    least = F.least("na", "nb")
    n = lines.groupBy("a_id", "b_id").agg(F.sum(least).alias("Equal"), F.sum(F.col("na") - least).alias("Deleted"), F.sum(F.col("nb") - least).alias("Inserted"))
    return n.unpivot(["a_id", "b_id"], ["Equal", "Deleted", "Inserted"], "status", "n").where("n > 0")


def diff_by_position(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, status, n): the lines at equal places, Equal or Unknown; what is over is Deleted or Inserted."""
    a, b = sides(pairs, hashed)
    both = a.withColumnRenamed("i", "p").join(b.withColumnRenamed("j", "p"), ["a_id", "b_id", "p"], "full_outer")
    state = F.when(F.col("ha").isNull(), "Inserted").when(F.col("hb").isNull(), "Deleted").when(F.col("ha") == F.col("hb"), "Equal").otherwise("Unknown")
    return both.groupBy("a_id", "b_id", state.alias("status")).agg(F.count("*").alias("n"))


def zip_remainder(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, zipped, deleted, inserted): how many lines are paired by place, and what is left of either side."""
    n = hashed.groupBy("doc_id").agg(F.count("*").alias("n"))
    both = pairs.select("a_id", "b_id").join(n.select(F.col("doc_id").alias("a_id"), F.col("n").alias("na")), "a_id", "left")
    both = both.join(n.select(F.col("doc_id").alias("b_id"), F.col("n").alias("nb")), "b_id", "left").na.fill(0, ["na", "nb"])
    least = F.least("na", "nb")
    return both.select("a_id", "b_id", least.alias("zipped"), (F.col("na") - least).alias("deleted"), (F.col("nb") - least).alias("inserted"))


def common_ends(pairs: DataFrame, hashed: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(a_id, b_id, prefix, suffix, shorter): equal lines at both ends; 0 where their share of the shorter side is too small."""
    n = hashed.groupBy("doc_id").agg(F.count("*").alias("n"))
    a, b = sides(pairs, hashed)
    size = pairs.select("a_id", "b_id").join(n.select(F.col("doc_id").alias("a_id"), F.col("n").alias("na")), "a_id").join(n.select(F.col("doc_id").alias("b_id"), F.col("n").alias("nb")), "b_id")
    size = size.withColumn("shorter", F.least("na", "nb"))
    front = a.withColumnRenamed("i", "p").join(b.withColumnRenamed("j", "p"), ["a_id", "b_id", "p"]).where("ha <> hb").groupBy("a_id", "b_id").agg(F.min("p").alias("front"))
    back_a = a.join(size, ["a_id", "b_id"]).select("a_id", "b_id", (F.col("na") - 1 - F.col("i")).alias("p"), "ha")
    back_b = b.join(size, ["a_id", "b_id"]).select("a_id", "b_id", (F.col("nb") - 1 - F.col("j")).alias("p"), "hb")
    back = back_a.join(back_b, ["a_id", "b_id", "p"]).where("ha <> hb").groupBy("a_id", "b_id").agg(F.min("p").alias("back"))
    both = size.join(front, ["a_id", "b_id"], "left").join(back, ["a_id", "b_id"], "left")
    enough = lambda c: F.when(c / F.col("shorter") >= threshold, c).otherwise(0).cast("long")
    return both.select("a_id", "b_id", enough(F.coalesce("front", "shorter")).alias("prefix"), enough(F.coalesce("back", "shorter")).alias("suffix"), "shorter")


def _short(hashed: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2, s): digests as two numbers and content scores, without the lines."""
    return hashed.select("doc_id", "line_no", F.xxhash64("h").alias("h1"), F.xxhash64("h", F.lit(1)).alias("h2"), T.content_score(F.col("line")).alias("s"))


def common_runs(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, i, j, n, score): every maximal run of lines common to both sides, by diagonals of the join on digests."""
    ids, held = pairs.select("a_id", "b_id"), _short(hashed)
    a = ids.join(held.withColumnsRenamed({"doc_id": "a_id", "line_no": "i"}), "a_id")
    b = ids.join(held.drop("s").withColumnsRenamed({"doc_id": "b_id", "line_no": "j"}), "b_id")
    met = a.join(b, ["a_id", "b_id", "h1", "h2"]).select("a_id", "b_id", "i", "j", (F.col("i") - F.col("j")).alias("d"), "s")
    w = Window.partitionBy("a_id", "b_id", "d").orderBy("i")
    met = met.withColumn("island", F.col("i") - F.row_number().over(w))
    return met.groupBy("a_id", "b_id", "d", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").alias("n"), F.sum("s").alias("score")).drop("d", "island")


def has_common_run(pairs: DataFrame, hashed: DataFrame, least: int = 3) -> DataFrame:
    """(a_id, b_id, has_run): whether both sides hold the same `least` lines in a row; by their digests, no runs are made."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    ahead = lambda c: [F.lead(c, k).over(w) for k in range(1, least)]
    grams = hashed.select("doc_id", "line_no", "h").select("doc_id", F.col("h"), *[c.alias(f"h{k}") for k, c in enumerate(ahead("h"), 1)])
    last = f"h{least - 1}" if least > 1 else "h"
    names = ["h", *[f"h{k}" for k in range(1, least)]]
    grams = grams.where(F.col(last).isNotNull()).select("doc_id", F.xxhash64(*names).alias("g1"), F.xxhash64(*names, F.lit(1)).alias("g2")).distinct()
    ids = pairs.select("a_id", "b_id")
    a, b = ids.join(grams.withColumnRenamed("doc_id", "a_id"), "a_id"), ids.join(grams.withColumnRenamed("doc_id", "b_id"), "b_id")
    found = a.join(b, ["a_id", "b_id", "g1", "g2"], "left_semi").select("a_id", "b_id").distinct().withColumn("has_run", F.lit(True))
    return ids.join(found, ["a_id", "b_id"], "left").select("a_id", "b_id", F.coalesce("has_run", F.lit(False)).alias("has_run"))


def longest_run(pairs: DataFrame, hashed: DataFrame, scored: bool = False) -> DataFrame:
    """The longest common run of each pair; of equal ones the first in a, then in b. Scored: most content first."""
    runs = common_runs(pairs, hashed)
    rank = [F.desc("score")] if scored else []
    w = Window.partitionBy("a_id", "b_id").orderBy(*rank, F.desc("n"), "i", "j")
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def lines_related(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, na, nb, met_a, met_b, related): shares of lines found on the other side; related from a fifth of the smaller."""
    a, b = sides(pairs, hashed)
    seen_b = b.select("a_id", "b_id", F.col("hb").alias("ha"), F.lit(1).alias("m")).distinct()
    seen_a = a.select("a_id", "b_id", F.col("ha").alias("hb"), F.lit(1).alias("m")).distinct()
    of_a = a.join(seen_b, ["a_id", "b_id", "ha"], "left").groupBy("a_id", "b_id").agg(F.count("*").alias("na"), F.count("m").alias("met_a"))
    of_b = b.join(seen_a, ["a_id", "b_id", "hb"], "left").groupBy("a_id", "b_id").agg(F.count("*").alias("nb"), F.count("m").alias("met_b"))
    smaller = F.when(F.col("na") <= F.col("nb"), F.col("met_a") / F.col("na")).otherwise(F.col("met_b") / F.col("nb"))
    return of_a.join(of_b, ["a_id", "b_id"]).select("a_id", "b_id", "na", "nb", "met_a", "met_b", (smaller >= 0.2).alias("related"))


def unrelated(pairs: DataFrame, hashed: DataFrame, least: int = 4) -> DataFrame:
    """(a_id, b_id, unrelated): both sides have `least` lines or more and none in common."""
    r = lines_related(pairs, hashed)
    return r.select("a_id", "b_id", ((F.col("na") >= least) & (F.col("nb") >= least) & (F.col("met_a") == 0)).alias("unrelated"))


def diagonal_stats(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, least, mean, most_of_body): token similarity of lines at equal places, for pairs of equal length."""
    n = hashed.groupBy("doc_id").agg(F.count("*").alias("n"))
    even = pairs.select("a_id", "b_id").join(n.select(F.col("doc_id").alias("a_id"), "n"), "a_id").join(n.select(F.col("doc_id").alias("b_id"), "n"), ["b_id", "n"]).select("a_id", "b_id")
    a, b = sides(even, hashed)
    met = a.join(b.withColumnRenamed("j", "i"), ["a_id", "b_id", "i"])
    tokens = lambda c: F.array_distinct(T.letter_tokens(F.col(c)))
    met = met.withColumn("s", T.jaccard(tokens("line_a"), tokens("line_b"), 1.0))
    body = F.coalesce(F.max(F.when(F.col("i") > 0, F.col("s"))), F.lit(0.0))
    return met.groupBy("a_id", "b_id").agg(F.round(F.min("s"), 6).alias("least"), F.round(F.avg("s"), 6).alias("mean"), F.round(body, 6).alias("most_of_body"))


def residual_unrelated(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a_id, b_id, residual_unrelated): both have a second line, and share no significant token after the first."""
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    held = lines.where("line_no > 0").select("doc_id", F.explode(T.significant(F.col("line"))).alias("t")).distinct()
    p = pairs.select("a_id", "b_id")
    met = p.join(held.withColumnRenamed("doc_id", "a_id"), "a_id").join(held.withColumnRenamed("doc_id", "b_id"), ["b_id", "t"]).select("a_id", "b_id").distinct().withColumn("met", F.lit(True))
    p = p.join(n.select(F.col("doc_id").alias("a_id"), F.col("n").alias("na")), "a_id").join(n.select(F.col("doc_id").alias("b_id"), F.col("n").alias("nb")), "b_id")
    return p.join(met, ["a_id", "b_id"], "left").select("a_id", "b_id", ((F.col("na") >= 2) & (F.col("nb") >= 2) & F.col("met").isNull()).alias("residual_unrelated"))


def first_difference(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, first_difference, ours, theirs): the first place where two sequences differ, null if nowhere."""
    a, b = sides(pairs, hashed)
    a, b = a.select("a_id", "b_id", F.col("i").alias("p"), "ha"), b.select("a_id", "b_id", F.col("j").alias("p"), "hb")
    both = a.join(b, ["a_id", "b_id", "p"], "full_outer")
    differs = F.min(F.when(~F.col("ha").eqNullSafe(F.col("hb")), F.col("p")))
    return both.groupBy("a_id", "b_id").agg(differs.alias("first_difference"), F.count("ha").alias("ours"), F.count("hb").alias("theirs"))


def ladder(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, level): the first level at which a pair differs: order, held lines, number of lines, any line at all."""
    digest = lambda order: F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["h"]), ""))
    s = hashed.groupBy("doc_id").agg(digest(F.struct("line_no", "h")).alias("ordered"), digest(F.struct("h")).alias("held"), F.count("*").alias("n"), F.collect_set("h").alias("hs"))
    side = lambda k: s.select(F.col("doc_id").alias(f"{k}_id"), *[F.col(c).alias(f"{c}_{k}") for c in ("ordered", "held", "n", "hs")])
    both = pairs.select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    level = F.when(F.col("ordered_a") == F.col("ordered_b"), "same").when(F.col("held_a") == F.col("held_b"), "L1-opseq").when(F.col("n_a") == F.col("n_b"), "L2-inventory")
    return both.select("a_id", "b_id", level.when(F.arrays_overlap("hs_a", "hs_b"), "L3-histogram").otherwise("apart").alias("level"))
