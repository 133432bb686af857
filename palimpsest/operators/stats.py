"""Robust statistics of trials and ledgers, first-match classes and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import written

BINS = 1024
OCTAVE = 64  # bins for each doubling
NARROWER = 1  # times that bins are cut again


def _running(df: DataFrame, by: list[str], bin_: str) -> DataFrame:
    """Adds before: how many values lie in the bins of a group (or of a bin that is cut again) before each."""
    w = Window.partitionBy(*by).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group: n and q, the exact percentiles (linear between neighbours) in the order of shares.

    Counts of bins on a logarithmic scale, the same for all groups, tell in which bins the wanted ranks lie. Those bins
    are cut into BINS equal ones of the range that they really have, NARROWER times, and of what is left the distinct
    values are counted. Neither far values nor many equal ones put a group's values together; nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    size = F.lit(1) + F.floor((F.log2(F.abs("v")) + 1100) * OCTAVE)
    rows = rows.withColumn("b0", F.when(F.col("v") == 0, 0).when(F.col("v") > 0, size).otherwise(-size).cast("long"))
    counted = lambda r, key: r.groupBy(*key).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    bins = _running(counted(rows, [*by, "b0"]), by, "b0")
    total = bins.groupBy(*by).agg(F.sum("c").alias("n"))
    # the ranks on both sides of each percentile
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(s) * (F.col("n") - 1)).alias("rank")) for k, s in enumerate(shares)])).alias("w")
    wanted = total.select(*by, "n", at).select(*by, "n", "w.k", "w.rank", F.explode(F.array(F.floor("w.rank"), F.ceil("w.rank"))).alias("r")).distinct()
    key = [*by, "b0"]
    inside = wanted.withColumn("base", F.lit(0).cast("long")).join(bins, by)
    for level in range(1, NARROWER + 2):
        # a row for each wanted rank; written, so that a pass over the values does not hold the passes before it
        inside = written(inside.where("r - base >= before and r - base < before + c").withColumn("base", F.col("base") + F.col("before")).drop("before", "c"), "ranks")
        chosen = inside.select(*key, "low", "high").distinct()
        inside = inside.drop("low", "high")
        last = level > NARROWER
        place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        rows = rows.join(chosen, key).withColumn(f"b{level}", F.col("v") if last else F.when(F.col("high") > F.col("low"), place).otherwise(0).cast("int")).drop("low", "high")
        cut = _running(counted(rows, [*key, f"b{level}"]), key, f"b{level}")
        inside = inside.join(cut, key)
        key = [*key, f"b{level}"]
    met = written(inside.where("r - base >= before and r - base < before + c").withColumn("v", F.col("low")), "ranks")
    one = met.groupBy(*by, "n", "k", "rank").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    one = one.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    return one.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))


def median_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, median, and the median distance from it (unscaled)."""
    center = percentiles(df, by, value, [0.5]).select(*by, "n", F.col("q")[0].alias("median"))
    away = df.join(center, by).withColumn("__away", F.abs(F.col(value) - F.col("median")))
    return center.join(percentiles(away, by, "__away", [0.5]).select(*by, F.col("q")[0].alias("mad")), by)


def verdicts(df: DataFrame, by: str, side: str, value: str, noise: float = 0.05) -> DataFrame:
    """Per group: medians of sides A and B and whether B is worse, better or within the noise band."""
    s = median_mad(df, [by, side], value)
    a = s.where(F.col(side) == "A").select(by, F.col("n").alias("na"), F.col("median").alias("ma"), F.col("mad").alias("da"))
    b = s.where(F.col(side) == "B").select(by, F.col("n").alias("nb"), F.col("median").alias("mb"))
    both = a.join(b, by, "full_outer")
    band = F.greatest(noise * F.col("ma"), 1.5 * F.col("da"))
    gap = F.col("mb") - F.col("ma")
    verdict = F.when(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0)) == 0, "insufficient").when(gap > band, "regress").when(gap < -band, "improve").otherwise("noise")
    return both.select(by, F.round("ma", 6).alias("median_a"), F.round("mb", 6).alias("median_b"), verdict.alias("verdict"))


def compare_ledgers(a: DataFrame, b: DataFrame, key: str, score: str, band: float = 0.0) -> DataFrame:
    """Per key: both scores, their difference, and only_a, only_b, drop, rise or same."""
    both = a.select(key, F.col(score).alias("sa")).join(b.select(key, F.col(score).alias("sb")), key, "full_outer")
    kind = F.when(F.col("sb").isNull(), "only_a").when(F.col("sa").isNull(), "only_b").when(F.col("sb") < F.col("sa") - band, "drop").when(F.col("sb") > F.col("sa") + band, "rise").otherwise("same")
    return both.select(key, F.round("sa", 6).alias("score_a"), F.round("sb", 6).alias("score_b"), F.round(F.col("sb") - F.col("sa"), 6).alias("delta"), kind.alias("kind"))


def ratchet(base: DataFrame, now: DataFrame) -> DataFrame:
    """Rows that appeared (NEW) and rows that went (FIXED), each once."""
    new = now.subtract(base).withColumn("change", F.lit("NEW"))
    return new.unionByName(base.subtract(now).withColumn("change", F.lit("FIXED")))


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def findings(df: DataFrame, key: str, detectors: dict[str, Column]) -> DataFrame:
    """(key, finding): a row for each detector that holds of a row."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in detectors.items()]))
    return df.select(key, F.explode(held).alias("finding"))


def summarize(verdicts: DataFrame) -> DataFrame:
    """One row: fixtures, how many got worse and better, and the overall verdict."""
    is_ = lambda v: F.col("verdict") == v
    overall = F.when(F.bool_or(is_("regress")), "regress").when(F.bool_or(is_("improve")), "improve_or_mixed").otherwise("noise")
    return verdicts.agg(F.count("*").alias("fixtures"), F.count_if(is_("regress")).alias("regress"), F.count_if(is_("improve")).alias("improve"), overall.alias("overall"))


def ledger_deltas(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """One row: pairs in both ledgers, and how their mean, median and tenth percentile moved."""
    both = a.select(key, F.col(score).alias("sa")).join(b.select(key, F.col(score).alias("sb")), key).withColumn("one", F.lit(1))
    q = lambda c: percentiles(both, ["one"], c, [0.5, 0.1]).select("one", F.col("q").alias(f"q_{c}"))
    means = both.groupBy("one").agg(F.count("*").alias("pairs"), F.round(F.avg("sb") - F.avg("sa"), 6).alias("mean_delta"))
    gap = lambda k: F.round(F.col("q_sb")[k] - F.col("q_sa")[k], 6)
    return means.join(q("sa"), "one").join(q("sb"), "one").select("pairs", "mean_delta", gap(0).alias("median_delta"), gap(1).alias("p10_delta"))
