"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A unit vector, padded to a power of two, goes through three random sign flips, each followed by a Hadamard
transform; its hash is the signed axis nearest to the result. A table joins `depth` hashes of independent rotations,
and depth grows with the logarithm of the number of vectors, so that the share of all vectors that a query is
compared with falls as tables grow: 12 tables and 8 probes in each at depth 1 (below 10,000 vectors), 24 and 128 at
depth 2 (below a million), 36 and 4096 at depth 3. A query probes the joined axes of least total distance. Probes are
as many as random vectors, which have no near neighbours, need to be found at nine of ten; see the tests.
Work is dealt by table and first axis; the other axes choose the vectors compared within. Large first axes are
split into chunks of CHUNK vectors and CHUNK queries, so that one is many tasks' work, and only the best of each
chunk leave it. Equal vectors are hashed and ranked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, stored, table

NEAREST = 5
TABLES = 12  # for each unit of depth
PROBES = (8, 128, 4096)  # at depths 1, 2, 3; beyond, 32 times as many for each depth more
SLICE = 1 << 22  # joined axes weighed at a time
NEAR_AXES = 24  # of each hash, that probes are made of
MOST_PER_AXIS = 100
CHUNK = 4096
CLOSE = 1e-9  # beyond what the order of additions can change


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """The t-th pseudo-rotation of unit rows, padded with zeros to a power of two."""
    n = 1 << max(x.shape[1] - 1, 0).bit_length()
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng(1000 + t)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def depth_for(n: int) -> int:
    """How many hashes a table joins for n vectors."""
    return max(1, int(np.log(max(n, 1)) / np.log(MOST_PER_AXIS) + 1e-9))


def probes_for(depth: int) -> int:
    return PROBES[min(depth, len(PROBES)) - 1] * 32 ** max(0, depth - len(PROBES))


def signed(x: np.ndarray, t: int) -> np.ndarray:
    """How near each row's t-th rotation is to every signed axis (2 axis + sign)."""
    y = rotated(x, t)
    return np.stack((y, -y), axis=2).reshape(len(y), -1)


def joined_axes(x: np.ndarray, t: int, depth: int, probes: int) -> np.ndarray:
    """The nearest joined axes of each row in table t, nearest first; the first axis is the highest digit."""
    near = [signed(x, t * depth + k) for k in range(depth)]
    width = near[0].shape[1]
    if probes == 1:
        code = np.zeros(len(x), np.int64)
        for s in near:
            code = code * width + s.argmax(axis=1)
        return code[:, None]
    rows = max(1, SLICE // (min(probes, NEAR_AXES ** (depth - 1)) * NEAR_AXES))
    return np.concatenate([_nearest_joined([s[a : a + rows] for s in near], depth, probes) for a in range(0, max(len(x), 1), rows)])


def _nearest_joined(near: list[np.ndarray], depth: int, probes: int) -> np.ndarray:
    n, width = near[0].shape
    code, far = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for s in near:
        axis = np.argsort(-s, axis=1, kind="stable")[:, : min(NEAR_AXES, width) if depth > 1 else width]
        value = np.take_along_axis(s, axis, axis=1)
        far = (far[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * width + axis[:, None, :]).reshape(n, -1)
        best = np.argsort(far, axis=1, kind="stable")[:, :probes]
        far, code = np.take_along_axis(far, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def _hashed(tables: int, depth: int, probes: int | None):
    """Rows id, x -> d, t, axis, id, codes, x: a row for each table and first axis; probes None: every axis, all codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                part = batch.take(pa.array(rows))
                x = part.column(1).flatten().to_numpy().reshape(-1, d).astype(np.float64)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                width = 2 << max(int(d) - 1, 0).bit_length()
                rest = width ** (depth - 1)
                for t in range(tables):
                    if probes is None:
                        row, axis = np.repeat(np.arange(len(x)), width), np.tile(np.arange(width), len(x))
                        codes, ends = np.empty(0, np.int64), np.zeros(len(row) + 1, np.int64)
                    else:
                        code = joined_axes(x, t, depth, probes)
                        order = np.argsort(code // rest, axis=1, kind="stable")
                        code = np.take_along_axis(code, order, axis=1)
                        row, first, codes = np.repeat(np.arange(len(x)), code.shape[1]), (code // rest).ravel(), (code % rest).ravel()
                        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] != first[:-1]))))
                        row, axis, ends = row[new], first[new], np.append(new, len(codes))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), d, np.int32)), pa.array(np.full(len(row), t, np.int32)), pa.array(axis.astype(np.int32)), part.column(0).take(at), list_array(codes, ends, pa.int64()), part.column(1).take(at)],
                        names=["d", "t", "axis", "id", "codes", "x"],
                    )

    return run


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = group["x"].combine_chunks()
    return group["id"].to_numpy(), x.flatten().to_numpy().reshape(len(x), -1).astype(np.float64)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal pairs get equal values."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _rerank(k: int):
    """The k nearest to each query of a chunk's items; a query with codes is compared with the items that have one of them."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if len(queries) and len(items):
            q_id, q = _matrix(queries)
            i_id, x = _matrix(items)
            unit, q_unit = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
            asked = queries["codes"].combine_chunks()
            ends, codes = asked.offsets.to_numpy(), asked.flatten().to_numpy()
            ends = ends - ends[0]
            have = items["codes"].combine_chunks().flatten().to_numpy()
            order = np.argsort(have, kind="stable")
            have = have[order]
            for j in range(len(q)):
                wanted = codes[ends[j] : ends[j + 1]]
                if len(wanted):
                    low, high = np.searchsorted(have, wanted), np.searchsorted(have, wanted, side="right")
                    at = np.concatenate([order[a:b] for a, b in zip(low.tolist(), high.tolist())])
                    rough = unit[at] @ q_unit[j]
                else:
                    at, rough = order, unit[order] @ q_unit[j]
                if not len(at):
                    continue
                keep = min(k, len(at))
                close = at[rough >= -np.partition(-rough, keep - 1)[keep - 1] - CLOSE]
                s = cosine(np.broadcast_to(q[j], (len(close), x.shape[1])), x[close])
                best = np.lexsort((i_id[close], -s))[:k]
                out_q.append(np.full(len(best), q_id[j]))
                out_i.append(i_id[close[best]])
                out_s.append(s[best])
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return pa.table({"query": cat(out_q, np.int64), "item": cat(out_i, np.int64), "score": cat(out_s, np.float64)})

    return run


def _ranked(queries: DataFrame, items: DataFrame, depth: int, probes: int | None, k: int) -> DataFrame:
    """The k best items of each chunk that a query looks into: query, item, score."""
    kind = items.schema["x"].dataType.simpleString()
    schema = f"d int, t int, axis int, id long, codes array<long>, x {kind}"
    tables = TABLES * depth if probes else 1
    index = items.mapInArrow(_hashed(tables, depth, 1), schema)
    probe = queries.mapInArrow(_hashed(tables, depth, probes), schema)
    key = ["d", "t", "axis"]
    sizes = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    size = stored(sizes(index, "parts").join(sizes(probe, "blocks"), key), "nearest-sizes")  # 2 x dimension x tables rows
    whole = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    index = index.join(size, key).withColumn("part", mine("parts")).withColumn("block", whole("blocks"))
    probe = probe.join(size, key).withColumn("part", whole("parts")).withColumn("block", mine("blocks"))
    key = [*key, "part", "block"]
    found = probe.drop("parts", "blocks").groupBy(*key).cogroup(index.drop("parts", "blocks").groupBy(*key)).applyInArrow(_rerank(k), "query long, item long, score double")
    found = found.distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query", "item", "score")


def search(vectors: DataFrame, is_query, k: int = NEAREST, depth: int | None = None) -> DataFrame:
    """Per query: query_id, rank, vec_id, score of the k nearest other vectors found, by cosine in double precision.

    vectors needs vec_id and embedding (of a vec_id that repeats the first vector in order counts); is_query is a condition on them; other columns are ignored. Rows
    without an id, and vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    are vectors of different lengths compared. Ties go to the smaller vec_id. Queries for which the probed buckets
    hold fewer than k others are searched against every vector.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    x = F.col("embedding").cast("array<float>" if single else "array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    rows = rows.where(finite & F.exists("x", lambda v: v != 0))
    rows = rows.groupBy("id").agg(F.min(F.struct("x", "q")).alias("r")).select("id", "r.x", "r.q")
    # of equal vectors the k + 1 smallest ids can be among a query's nearest; the first stands for all
    same = Window.partitionBy("x").orderBy("id")
    copies = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).withColumn("item", F.first("id").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    copies = stored(copies.select("id", "item", "x"), "nearest-copies")
    items = copies.where("id = item").select("id", "x")
    asked = stored(rows.where("q").select("id", "x").join(items.select(F.col("id").alias("query"), "x"), "x").select("id", "query", "x"), "nearest-queries")
    queries = asked.select(F.col("query").alias("id"), "x").dropDuplicates(["id"])
    depth = depth or depth_for(items.count())
    near = stored(_ranked(queries, items, depth, probes_for(depth), k + 1), "nearest-found")
    per_size = items.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("there"))
    enough = near.groupBy("query").agg(F.count("*").alias("n"))
    short = queries.join(enough, F.col("id") == F.col("query"), "left").join(per_size, F.size("x") == F.col("d"))
    short = stored(short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), "there")).select("id", "x"), "nearest-short")
    if short.take(1):
        rest = _ranked(short, items, 1, None, k + 1)
        near = near.join(short.select(F.col("id").alias("query")), "query", "left_anti").union(rest)
    named = asked.select(F.col("id").alias("query_id"), "query").join(near, "query").join(copies.select("item", F.col("id").alias("vec_id")), "item")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    named = named.where("vec_id <> query_id").withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return named.select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
