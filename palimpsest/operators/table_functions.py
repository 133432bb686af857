"""Table functions for SQL: a row for each stretch of two texts' difference, and for each unit of a text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from palimpsest.operators import diff


@udtf(returnType="seq_no int, status string, text string")
class DiffUnits:
    """diff_units(a, b): Equal, Deleted and Inserted stretches in order; a null text is empty."""

    def eval(self, a: str, b: str):
        for k, (status, text) in enumerate(diff.aligned(a or "", b or "", True)):
            yield k, status, text


@udtf(returnType="unit_no int, unit string")
class TextUnits:
    """text_units(text): the words, separators and marks that texts are compared by; a null text has none."""

    def eval(self, text: str):
        units = [w for s in diff.paragraphs(text) for w in [*diff.words(s), diff.MARK]]
        for k, unit in enumerate(units):
            yield k, unit


def register(spark: SparkSession) -> None:
    spark.udtf.register("diff_units", DiffUnits)
    spark.udtf.register("text_units", TextUnits)
