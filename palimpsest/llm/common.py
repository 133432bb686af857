"""Helpers shared by the training-data operators: chunked Arrow text, word hashes, scratch tables, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 3 << 20
MOST_BITS = 1 << 27
PART_ROWS = 10_000
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode, where none is set, one of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = spark.conf.get("palimpsest.scratch.dir", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="palimpsest-")
            spark.conf.set("palimpsest.scratch.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffles behind the table are not needed once it is written, so Spark may delete their files then.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true", BATCH: str(BATCH_ROWS)}  # rows go to Python in batches of a few megabytes
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables that stored() wrote and that no pending DataFrame reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hands memory that a worker no longer uses back to the system: workers of several stages live side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not on every platform
        pass


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of about max_bytes of text (at least a row, never part of one), with the text column; null is empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            # a copy: kernels go wrong on casts of slices
            yield batch.slice(a, b - a), pc.fill_null(pa.concat_arrays([col.slice(a, b - a)]).cast(pa.large_string()), "")
        give_back()


def split_words(col: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without \\x20, \\x09-\\x0D) of a text column and the n + 1 offsets of its rows in them."""
    if lower:
        col = pc.ascii_lower(col)
    lists = pc.ascii_split_whitespace(col)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not keep.all():
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        flat = flat.filter(pa.array(keep))
    return flat, offsets


def word_hashes(flat: pa.Array, *seeds: int) -> list[np.ndarray]:
    """For each seed, the 64-bit hash of every word; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    return [np.fromiter((xxhash.xxh3_64_intdigest(w, seed=s) for w in words), np.uint64, len(words))[at] for s in seeds]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def rolling(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64 with an odd base, of all runs of n values, across row borders too."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    down = np.full(len(values), inverse, np.uint64)
    up = np.full(len(values), base, np.uint64)
    down[0] = up[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(down), dtype=np.uint64)))
    return (sums[n:] - sums[:-n]) * np.multiply.accumulate(up)[n - 1 :]


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Word positions at which a run of n words lies within one row."""
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    total = int(lengths.sum())
    first = np.repeat(offsets[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return first + np.arange(total, dtype=np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


def bitmap_size(n: int) -> int:
    """Bits for n ids: a power of two, 8 for each or more, as long as that is no more than MOST_BITS (16 MB)."""
    return min(MOST_BITS, max(1 << 18, 1 << int(8 * n).bit_length()))


def slot_bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of slots (numbers below bits, in a column slot); what comes to the driver has at most its size."""
    per = 32768
    rows = (
        slots.groupBy(F.floor(F.col("slot") / per).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod(F.col("slot"), F.lit(per))).alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["bucket"] * per // 8 : r["bucket"] * per // 8 + len(part)] = part
    return out


def in_bitmap(table_bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((table_bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


def prune_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows whose key may be in ids: a bitmap goes to the tasks, 16 MB at most whatever the data's size.

    Some other rows can stay, so an exact join has to follow; it then shuffles little more than what it needs. With
    more ids than a bitmap tells apart more of them stay, all in the end.
    """
    bits = bitmap_size(ids.count())
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    shared = df.sparkSession.sparkContext.broadcast(slot_bitmap(ids.select(slot.alias("slot")), bits))
    schema = df.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(shared.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(hit))

    return df.where(F.col(key).isNotNull()).withColumn("__slot", slot).mapInArrow(kept, schema)


def join_by_parts(rows: DataFrame, counts: DataFrame, key: list[str], spread: list[str]) -> DataFrame:
    """rows joined with counts (key, n: how many rows have a key; written), without a task for all rows of a frequent key.

    Keys of over a thousandth of all rows, of which there are a thousand at most, are dealt by a hash of the columns
    `spread` to as many parts as they need.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(PART_ROWS, total // 1000)
    hot = counts.where(F.col("n") > limit).select(*key, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    found = [tuple(r) for r in hot.collect()]
    if not found:
        return rows.join(counts, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))  # a thousand rows at most
    parts = F.coalesce("__parts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("__parts")
    copies = counts.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return rows.join(copies, [*key, "__part"]).drop("__part")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for each end of edges(a, b): component is the smallest id reachable, itself included.

    Alternates large-star and small-star steps, each a grouped minimum over edges, until nothing changes; the
    number of rounds grows with the logarithm of the longest chain, and no group of edges is gathered in a task.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    digest = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").select("u", "v").distinct(), name)
        r = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        drop_stored(now)
        now = after
        if (r["n"], r["s"]) == digest:
            break
        digest = (r["n"], r["s"])
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
