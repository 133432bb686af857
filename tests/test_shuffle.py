"""What queries over pairs of texts shuffle: each text a few times, not once for each of its words."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff, pairing, similarity, windows
from palimpsest.plans.queries import REGISTRY
from palimpsest.sources.tables import hashed_lines


def written_bytes(spark) -> int:
    """Of all shuffles of this session so far."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def shuffled(spark, make) -> int:
    """By the rows of make(), with tables too large to broadcast."""
    held, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        make().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    return written_bytes(spark) - before


@pytest.fixture(scope="module")
def texts(spark):
    """Forty pairs of texts of five lines in 200 words each, of which one line is in both: (pairs, documents, characters)."""
    rng = random.Random(11)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(200))
    rows = []
    for k in range(40):
        same = line()
        rows += [(2 * k, "\n".join([*(line() for _ in range(4)), same])), (2 * k + 1, "\n".join([same, *(line() for _ in range(4))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(40)], "a_id long, b_id long")
    return pairs, docs, docs.agg(F.sum(F.length("text"))).first()[0]


def test_residual_candidates_shuffle_no_tokens(spark, texts):
    pairs, docs, chars = texts
    assert shuffled(spark, lambda: pairing.residual_candidates(pairs, hashed_lines(docs))) < 3 * chars


def test_residual_pairs_shuffle_no_tokens(spark, texts):
    pairs, docs, chars = texts
    assert shuffled(spark, lambda: pairing.residual_pairs(pairs, hashed_lines(docs))) < 3 * chars


def test_revisions_shuffle_each_text_twice(spark, texts):
    pairs, docs, chars = texts
    assert shuffled(spark, lambda: similarity.revision_rows(similarity.revised(pairs, docs))) < 3 * chars


def moving(seed, n):
    """Pairs of texts of which some lines are moved, some with a word changed, some with odd spaces; (pairs' texts)."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("alpha beta; gamma delta, epsilon的 zeta\u3000eta theta iota\tkappa lambda mu nu xi".split(" ")) + str(rng.randrange(40)) for _ in range(rng.choice([3, 6, 12, 30])))
    for _ in range(n):
        a = [line() for _ in range(rng.randint(1, 8))]
        b = [x.replace(" ", "\u00a0", 1) if rng.random() < 0.2 else x + " more" if rng.random() < 0.3 else x for x in a if rng.random() < 0.9] + [line()]
        rng.shuffle(b)
        yield "\n".join(a), "\n".join(b)


@pytest.fixture(scope="module")
def moved(spark):
    rows = [x for k, ab in enumerate(moving(5, 150)) for x in ((2 * k, ab[0]), (2 * k + 1, ab[1]))]
    return spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(150)], "a_id long, b_id long"), spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("long", [2000, 6])
def test_lists_of_revisions_are_those_of_the_moved_rows(spark, moved, long):
    pairs, docs = moved
    want = similarity.moved_revisions(diff.revisions(diff.diff(pairs, docs)))
    got = similarity.revision_rows(similarity.revised(pairs, docs, long=long, piece=4))
    assert sorted(got.schema.names) == sorted(want.schema.names)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(map(tuple, want.select(*got.columns).collect()), key=repr) and sum(r[3] == "Moved" for r in rows) > 40


def test_moves_shuffle_each_text_twice(spark, texts):
    pairs, docs, chars = texts
    # lines of two copies in another order, so that they are deleted and inserted
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.array_join(F.reverse(F.split("text", "\n")), "\n")).otherwise(F.col("text")))
    assert shuffled(spark, lambda: similarity.detect_moves(pairs, hashed_lines(docs))) < 3 * chars


def test_turned_runs_are_those_of_the_rows(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for pair in range(200):
        status = [rng.choice(["Equal", "Equal", "Deleted", "Deleted", "Inserted"]) for _ in range(rng.randint(1, 24))]
        table = [rng.random() < 0.5 for _ in status]
        rows += [(pair, 0, k, s, None if s == "Inserted" else k, None if s == "Deleted" else k, t) for k, (s, t) in enumerate(zip(status, table))]
        runs = [[k for k in range(len(status)) if status[k] == s and sum(status[x] != status[x - 1] for x in range(1, k + 1)) == r] for r, s in enumerate(s for k, s in enumerate(status) if not k or status[k - 1] != s)]
        turned = windows.turned_runs([status[r[0]] for r in runs], lambda r: (table[k] for k in runs[r]))
        want[pair] = sorted(k for r, n in turned for k in runs[r][:n])
    df = spark.createDataFrame(rows, "a_id long, b_id long, seq_no int, status string, i int, j int, in_table boolean")
    got = {pair: [] for pair in want}
    equal = {(pair, k) for pair, _, k, s, *_ in rows if s == "Equal"}
    for r in windows.promote_skip_ahead(df).where("status = 'Deleted'").collect():
        if (r["a_id"], r["i"]) in equal:
            got[r["a_id"]].append(r["i"])
    assert {p: sorted(x) for p, x in got.items()} == want and sum(map(len, want.values())) > 50


@pytest.fixture(scope="module")
def folder(texts, tmp_path_factory):
    """A folder with the texts as its table of documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    texts[1].write.parquet(f"{path}/documents.parquet")
    return path


def test_revision_counts_shuffle_each_text_twice(spark, texts, folder):
    assert shuffled(spark, lambda: REGISTRY["revision_counts"][0](spark, folder)) < 3 * texts[2]


def test_revision_json_shuffles_each_text_twice(spark, texts, folder):
    assert shuffled(spark, lambda: REGISTRY["revision_json"][0](spark, folder)) < 3 * texts[2]


def test_revisions_array_shuffles_each_text_twice(spark, texts, folder):
    assert shuffled(spark, lambda: REGISTRY["revisions_array"][0](spark, folder)) < 3 * texts[2]


def test_arrays_are_those_of_the_moved_rows(spark, moved):
    pairs, docs = moved
    want = diff.revisions_to_json(similarity.moved_revisions(diff.revisions(diff.diff(pairs, docs))))
    got = similarity.revision_arrays(similarity.revised(pairs, docs))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
