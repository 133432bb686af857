"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where none is set, one of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("palimpsest.scratch.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("palimpsest.scratch.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what follows starts from the table, also after executors are lost."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many tasks as the session shuffles to: for rows that cost more than their bytes tell, which would come together in a few."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys))  # by the keys themselves it would be left out where df is dealt by them, and then put together
