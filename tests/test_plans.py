"""Plans that hold on skewed values, hot groups and long histories, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import packages, state, stats
from palimpsest.sources.tables import neighbour_pairs


@pytest.mark.parametrize("kind", ["outlier", "equal", "tiny", "mixed", "one", "close"])
def test_percentiles_of_skewed_values(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "outlier": [*rng.normal(0, 1, 4000), 1e300, -1e300], "equal": [7.5] * 3000 + [1.0, 9.0], "tiny": rng.random(3000) * 1e-200,
        "mixed": [*rng.normal(5, 1e-9, 2000), *rng.normal(-5, 1e3, 2000), *[0.0] * 500], "one": [3.0], "close": [*(1e6 + rng.random(3000) * 1e-3), 1.005e6],
    }[kind]
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0), ("b", None), ("c", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in stats.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b"} and got["b"] == (1, [2.0] * 5) and got["a"][0] == len(values)
    assert got["a"][1] == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


def test_neighbour_pairs_across_stretches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(["en", "de"])) for i in rng.sample(range(5000), 400)]
    last, want = {}, set()
    for i, source, lang in sorted(rows, key=lambda r: r[0]):
        if (source, lang) in last:
            want.add((last[source, lang], i))
        last[source, lang] = i
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string")
    for width in (10, 65_536):
        assert {tuple(r) for r in neighbour_pairs(docs, width).collect()} == want


def test_group_ids_hash_bytes(spark):
    def fnv(name):
        h = 2166136261
        for c in name.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        return h & 0x7FFFFFFF

    names = ["", "move1", "Verschoben_Ä", "移動", "é" * 50]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["h"] for r in df.select(packages.group_id_of(F.col("n")).alias("h")).collect()] == [fnv(n) for n in names]


def test_releases_in_their_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), k, rng.random() < 0.5) for k in range(900)]
    want = {}
    for user, _, back in rows:
        used = want.get(user, 0)
        want[user] = max(used - 1, 0) if back else min(used + 1, 3)
    df = spark.createDataFrame(rows, "user long, at long, back boolean")
    for width in (1, 7, 1000):
        got = state.released(df.withColumn("stretch", F.floor(F.col("at") / width)), "user", ["at"], F.col("back"), 3)
        assert {r["user"]: r["used"] for r in got.collect()} == want
