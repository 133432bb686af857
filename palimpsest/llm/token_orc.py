"""Token-ID output: ORC files of token ids in document order, and what their readers return.

Spark's ORC writer stores the ids of a document as an integer list (run-length encoded per stripe), keeps row
indexes every ROW_STRIDE rows and Bloom filters on doc_id, so that readers skip stripes and row groups by id and
read stripes in parallel. Files hold ranges of doc_id in ascending order; each row also has its file's number and
its first id's place in the file, so that places in the whole stream need only one total per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, scratch_dir, table, text_chunks
from .token_ids import TOKENIZER, encode_texts

END_ID = 2
ROW_STRIDE = 1000
STRIPE_BYTES = 16 << 20
ROW_SCHEMA = "doc_id long, part int, local_start long, ids array<int>"


def _encoded(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch, col in text_chunks(batches):
            ids, offsets = encode_texts(col, name)
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(col), part, np.int32)), pa.array(offsets[:-1] + start), list_array(ids, offsets, pa.int32())],
                names=["doc_id", "part", "local_start", "ids"],
            )
            start += int(offsets[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the token ids of every text, each followed by end_id, to ORC files in ascending doc_id order.

    docs needs doc_id (rows without one take no part) and text; other columns are ignored. A null or empty text is
    the end id alone. Rows of the same doc_id are kept, next to each other. An empty table gives files without rows.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    rows = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(_encoded(tokenizer, end_id), ROW_SCHEMA)
    (
        rows.write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on doc_id is pushed down to stripes, row indexes and Bloom filters."""
    return spark.read.schema(ROW_SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy().astype(np.int64)
        data = ids.flatten().to_numpy().astype("<u4").tobytes()
        at = ((offsets - offsets[0]) * 4).tolist() if len(offsets) else [0]
        view = memoryview(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets)), pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:])], pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals = read_token_orc(spark, path).select("part", (F.col("local_start") + F.size("ids")).alias("e")).groupBy("part").agg(F.max("e").alias("total"))
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = read_token_orc(spark, path).mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/token-orc-{uuid.uuid4().hex}"
    write_token_orc(table(spark, sf_dir, "documents"), path)
    return token_rows(spark, path)
