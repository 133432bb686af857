"""Hard-negative mining with bounds along a spanning tree of anchors.

Anchors meet the rows in blocks: BLOCK anchors that lie near one another, and CHUNK rows. The anchors of a block form
a spanning tree of least total distance, made once. For each chunk the tree is walked from its root, whose scores are
computed. A row's score at a child is its score at the parent plus or minus the length of the edge times the row's
norm, and never more than both norms allow. Only rows whose bounds reach into what is sought are scored again: for
positives, those that can be among the chunk's best of the anchor's label; for negatives, those that can lie in a
positive's window and among the best of it. Rows that are scored pass sharp bounds on, others wider ones.
What leaves a chunk is its best few for each anchor and positive, and the best of these are the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, table
from .nearest import rotated

POSITIVES = NEGATIVES = 5
LOW = 80  # of 100: the least share of a positive's score that a negative's has
SCALE = 256
BLOCK = CHUNK = 2048
EXACT = 2**53  # sums of whole numbers below it are exact in double precision
TREE = "d int, block long, node int, id long, label long, parent int, edge double"
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def whole(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of every component, as whole doubles."""
    return F.transform(x, lambda v: F.when(F.abs(scale * v.cast("double")) < float(EXACT), F.floor(scale * v.cast("double")).cast("double")).otherwise(scale * v.cast("double")))


def _matrix(col: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), d)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's algorithm from the first row: rows in the order they join, the place of each one's parent in it, edge lengths."""
    n, square = len(x), (x * x).sum(axis=1)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, link, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    for k in range(n):
        order[k], out[now] = now, False
        if k:
            parent[k], edge[k] = link[now], math.sqrt(near[now])
        # a little longer than it is, so that rounding never makes a bound too narrow
        far = np.maximum(square + square[now] - 2 * (x @ x[now]), 0) + 1e-12 * (square + square[now])
        closer = out & (far < near)
        near[closer], link[closer] = far[closer], k
        now = int(np.where(out, near, np.inf).argmin())
    return order, parent, edge


def _with_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the signed axis nearest to a pseudo-rotation of each anchor: anchors of one axis lie near one another."""
    for batch in batches:
        sizes, axis = np.diff(batch.column(2).offsets.to_numpy()), np.zeros(batch.num_rows, np.int32)
        for d in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == d)
            y = rotated(_matrix(batch.column(2).take(pa.array(rows)), int(d)), 0)
            axis[rows] = 2 * np.abs(y).argmax(axis=1) + (y[np.arange(len(y)), np.abs(y).argmax(axis=1)] < 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(axis)], names=["id", "label", "x", "d", "axis"])


def _tree(group: pa.Table) -> pa.Table:
    group = group.sort_by("id")
    d = group["d"][0].as_py()
    order, parent, edge = spanning_tree(_matrix(group["x"], d))
    group = group.take(pa.array(order))
    return pa.table(
        {"d": group["d"], "block": group["block"], "node": pa.array(np.arange(len(order), dtype=np.int32)), "id": group["id"], "label": group["label"], "parent": pa.array(parent.astype(np.int32)), "edge": pa.array(edge), "x": group["x"]}
    )


def _dot(x: np.ndarray, a: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return x @ a
    whole_a = [int(v) for v in a]
    return np.array([sum(int(v) * w for v, w in zip(row, whole_a)) for row in x] + [None], object)[:-1]


Wanted = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def walk(anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, x: np.ndarray, wanted: Wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, in tree order: its number, the rows that wanted(number, lowest, highest) asks for, their scores."""
    norm, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((anchors * anchors).sum(axis=1))
    exact = float(norm.max(initial=0)) * float(own.max(initial=0)) < EXACT / 2
    norm = norm * (1 + 1e-9)
    low, high = np.empty((len(anchors), len(x))), np.empty((len(anchors), len(x)))
    for v in range(len(anchors)):
        most = own[v] * norm + 1
        if parent[v] < 0:
            low[v], high[v] = -most, most
            scored = np.ones(len(x), bool)
        else:
            slack = edge[v] * norm + 1e-6
            low[v], high[v] = np.maximum(low[parent[v]] - slack, -most), np.minimum(high[parent[v]] + slack, most)
            scored = wanted(v, low[v], high[v])
        at = np.flatnonzero(scored)
        if 2 * len(at) > len(x) and exact:  # as cheap as a part
            every = x @ anchors[v]
            low[v], high[v], s = every, every, every[at]
        else:
            s = _dot(x[at], anchors[v], exact)
            near = s.astype(np.float64)
            spare = 0.0 if exact else 1e-9
            low[v, at], high[v, at] = near - spare * np.abs(near), near + spare * np.abs(near)
        if parent[v] < 0:
            at = np.flatnonzero(wanted(v, low[v], high[v]))
            s = s[at]
        yield v, at, s


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -math.inf


def _long(values: list) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())  # what no long can hold is an error


def _best_positives(k: int):
    """The chunk's k best rows of each anchor's label."""

    def run(tree: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(tree) and len(rows):
            tree = tree.sort_by("node")
            d = tree["d"][0].as_py()
            ids, labels, a_ids, a_labels = rows["id"].to_numpy(), rows["label"].to_numpy(), tree["id"].to_numpy(), tree["label"].to_numpy()

            def wanted(v: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                same = (labels == a_labels[v]) & (ids != a_ids[v])
                return same & (high >= _kth_largest(low[same], k))

            for v, at, s in walk(_matrix(tree["x"], d), tree["parent"].to_numpy(), tree["edge"].to_numpy(), _matrix(rows["x"], d), wanted):
                best = np.lexsort((ids[at], -s))[:k]
                for into, values in zip(out, ([a_ids[v]] * len(best), ids[at[best]].tolist(), s[best].tolist())):
                    into += values
        return pa.table({"anchor_id": _long(out[0]), "id": _long(out[1]), "score": _long(out[2])})

    return run


def _best_negatives(k: int, low_share: int):
    """The chunk's k best rows of other labels in the window of each positive of each anchor."""

    def run(tree: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        if len(tree) and len(rows):
            tree = tree.sort_by("node")
            d = tree["d"][0].as_py()
            ids, labels, a_ids, a_labels = rows["id"].to_numpy(), rows["label"].to_numpy(), tree["id"].to_numpy(), tree["label"].to_numpy()
            # (positive, least, most) of the windows that are not empty
            windows = [[(p["id"], -(-low_share * p["score"] // 100), p["score"]) for p in each or () if p["score"] >= 0] for each in tree["positives"].to_pylist()]

            def wanted(v: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                other, asked = labels != a_labels[v], np.zeros(len(ids), bool)
                for _, least, most in windows[v]:
                    sure = low[other & (low >= least) & (high <= most)]
                    asked |= (high >= max(least, _kth_largest(sure, k))) & (low <= most)
                return other & asked

            for v, at, s in walk(_matrix(tree["x"], d), tree["parent"].to_numpy(), tree["edge"].to_numpy(), _matrix(rows["x"], d), wanted):
                order = np.lexsort((ids[at], -s))
                down, at = s[order], at[order]
                for positive, least, most in windows[v]:
                    first, end = np.searchsorted(-down, [-most, -least + 1])
                    best = slice(int(first), int(min(end, first + k)))
                    n = len(down[best])
                    for into, values in zip(out, ([a_ids[v]] * n, [positive] * n, [most] * n, ids[at[best]].tolist(), down[best].tolist())):
                        into += values
        return pa.table({name: _long(x) for name, x in zip(("anchor_id", "positive_id", "positive_score", "id", "score"), out)})

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_share: int = LOW, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors needs vec_id, label and x, an array of whole numbers (see whole()); is_anchor is a condition on them;
    other columns are ignored. A score is the inner product of a row with the anchor. An anchor's positives are the
    rows of its label, itself aside, with the highest scores; the negatives of a positive are the rows of other labels
    with the highest scores from low_share percent of the positive's score up to that score, which no row has where it
    is negative. Ties go to the smaller vec_id. Rows without vec_id, label or vector, or with a null or non-finite
    component, take no part; vectors of other lengths than the anchor's are not compared with it. Of rows that repeat
    a vec_id the first in the order of vector and label counts. Anchors with no positive or no negative are left out;
    an empty table gives an empty result. Scores that a long can't hold end the job.
    """
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<double>").alias("x"), is_anchor.alias("anchor"))
    rows = rows.where("id is not null and label is not null and x is not null").where(finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("x", "label", "anchor")).alias("r")).select("id", "r.label", "r.x", "r.anchor", F.size("r.x").alias("d"))
    most = F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    kept = stored(rows.withColumn("most", most), "negatives-rows")
    x_type = "array<int>" if (kept.agg(F.max("most")).first()[0] or 0) < 2**31 else "array<double>"
    rows = kept.select("id", "label", F.col("x").cast(x_type).alias("x"), "d", "anchor")
    sizes = rows.groupBy("d").agg(F.ceil(F.count("*") / chunk).alias("chunks"), F.ceil(F.count_if("anchor") / block).alias("blocks"))
    sizes = stored(sizes.where("blocks > 0"), "negatives-sizes")  # a row for each length of vectors
    tree = stored(_trees(rows.where("anchor").select("id", "label", "x", "d"), block, x_type), "negatives-tree")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = rows.select("id", "label", "x", "d").join(sizes, "d").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("block", each("blocks")).drop("chunks", "blocks")

    def met(anchors: DataFrame, best, schema: str) -> DataFrame:
        asked = anchors.join(sizes.select("d", "chunks"), "d").withColumn("chunk", each("chunks")).drop("chunks")
        key = ["d", "block", "chunk"]
        return asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(best, schema)

    near = met(tree, _best_positives(positives), "anchor_id long, id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    near = stored(near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives")), "negatives-positives")
    found = met(tree.join(near, "id", "left"), _best_negatives(negatives, low_share), FOUND)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    found = stored(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives), "negatives-found")
    drop_stored(kept, sizes, tree, near)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _trees(anchors: DataFrame, block: int, x_type: str) -> DataFrame:
    """Anchors in blocks of about `block`, in order of their axes, with their places in the block's tree."""
    dealt = anchors.mapInArrow(_with_axis, f"id long, label long, x {x_type}, d int, axis int")
    count = dealt.groupBy("d", "axis").agg(F.count("*").alias("n"))
    before = Window.partitionBy("d").orderBy("axis").rowsBetween(Window.unboundedPreceding, -1)  # 2 d axes at most
    count = stored(count.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "negatives-axes")
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))
    dealt = dealt.join(count, ["d", "axis"]).withColumn("block", F.floor(place / block)).select("id", "label", "x", "d", "block")
    return dealt.groupBy("d", "block").applyInArrow(_tree, f"{TREE}, x {x_type}")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole(F.col("embedding")).alias("x"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
