"""Input tables, and the two kinds of document pairs that the pair operators compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines that hold a visible character, numbered from 0 within a document."""
    cut = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    return docs.select("doc_id", F.posexplode(cut).alias("line_no", "line"))


def hashed_lines(docs: DataFrame) -> DataFrame:
    return lines(docs).select("doc_id", "line_no", "line", F.sha1("line").alias("h"))


def first_holder_pairs(hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, shared): every document and the first holder of each line that it shares with an earlier one.

    However many documents hold a line, each of them meets its first holder alone, so there are no more pairs than
    lines, no line is too common to count, and none makes pairs of all its holders.
    """
    holders = hashed.select("h", "doc_id").distinct()
    first = holders.groupBy("h").agg(F.min("doc_id").alias("a_id"), F.count("*").alias("n")).where("n > 1").select("h", "a_id")
    return holders.join(first, "h").where("doc_id > a_id").groupBy("a_id", F.col("doc_id").alias("b_id")).agg(F.count("*").alias("shared"))


def neighbour_pairs(docs: DataFrame, width: int = 65_536) -> DataFrame:
    """(a_id, b_id): each document and the next one of its source and language.

    Groups are sorted in stretches of `width` ids, and a stretch's last document meets the first of the next one that
    has any, so that no task sorts a source with a share of all documents.
    """
    key = ["source", "lang"]
    rows = docs.select(*key, "doc_id", F.floor(F.col("doc_id") / width).alias("stretch"))
    first = rows.groupBy(*key, "stretch").agg(F.min("doc_id").alias("first"))
    first = first.withColumn("next", F.lead("first").over(Window.partitionBy(*key).orderBy("stretch")))
    ours = rows.withColumn("b", F.lead("doc_id").over(Window.partitionBy(*key, "stretch").orderBy("doc_id")))
    same = [ours[c].eqNullSafe(first[c]) for c in (*key, "stretch")]
    return ours.join(first, same, "left").select(F.col("doc_id").alias("a_id"), F.coalesce("b", "next").alias("b_id")).where("b_id is not null")


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, turn, a_text, b_text): consecutive turns of one role of a conversation."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return conversations.select(
        "conv_id", "role", F.lead("turn").over(w).alias("turn"), F.col("text").alias("a_text"), F.lead("text").over(w).alias("b_text")
    ).where("turn is not null")
