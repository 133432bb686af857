"""Readers of score ledgers and trial tables in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIALS = "round int, fixture string, tag string, real double, user double, sys double, maxrss string"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated trials; header lines, failed and short rows are left out."""
    rows = spark.read.csv(path, sep="\t", schema=TRIALS, mode="DROPMALFORMED")
    return rows.where("round is not null and real is not null and tag is not null")


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(pair, score) from tsv, csv, jsonl (objects with pair and score) or json (one object of pair: score)."""
    if kind in ("tsv", "csv"):
        rows = spark.read.csv(path, sep="\t" if kind == "tsv" else ",", schema="pair string, score double")
    elif kind == "jsonl":
        rows = spark.read.schema("pair string, score double").json(path)
    elif kind == "json":
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("pair", "score"))
    else:
        raise ValueError(f"unknown ledger kind: {kind}")
    return rows.where("pair is not null and score is not null")
