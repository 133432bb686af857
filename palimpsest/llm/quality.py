"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class gets a mean and a covariance from all labelled rows (held-out ones aside): shrunk towards the pooled
covariance and then towards its diagonal. The Cholesky factors are computed once and go to the tasks; a score is the logistic of the difference
of the Mahalanobis log-densities and log-priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, split_words, stored, table, text_chunks

THRESHOLD = 0.7
TO_POOLED = 0.1
TO_DIAGONAL = 0.05
RIDGE = 1e-3
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "marks", "symbols",
    "non_ascii", "lines", "distinct", "top_word", "same_as_before", "bare_symbol_words", "symbol_ends", "all_upper", "repeated_lines",
]

_KINDS = {"upper": 0, "lower": 1, "digit": 2, "mark": 3, "symbol": 4, "space": 5, "line": 6, "high": 7}


def _kinds() -> np.ndarray:
    kind = np.full(256, _KINDS["symbol"], np.int64)
    for chars, name in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"abcdefghijklmnopqrstuvwxyz", "lower"), (b"0123456789", "digit"), (b".,;:'\"()?-", "mark"), (b" \t\x0b\x0c\r", "space"), (b"\n", "line")):
        kind[list(chars)] = _KINDS[name]
    kind[0x80:] = _KINDS["high"]
    return kind


_KIND = _kinds()


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _by_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n).astype(float)


def _repeats(coded: pa.Array, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct values it has, and how often its most frequent one occurs."""
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = np.sort(row * max(len(coded.dictionary), 1) + code)
    at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
    count = np.diff(np.concatenate((at, [len(pair)])))
    owner = pair[at] // max(len(coded.dictionary), 1)
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    return _by_row(owner, n), most


def statistics(col: pa.Array) -> np.ndarray:
    """FEATURES of every row, transformed: logarithms of counts, square roots of shares. Finite for any text."""
    n = len(col)
    data, edges = _bytes_of(col)
    size = np.diff(edges)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    k = {name: kinds[:, i] for name, i in _KINDS.items()}
    flat, offsets = split_words(col)
    words = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(float)
    w = np.maximum(words, 1)
    mean = _by_row(row, n, length) / w
    sd = np.sqrt(np.maximum(_by_row(row, n, length**2) / w - mean**2, 0))
    coded = flat.dictionary_encode()
    distinct, most = _repeats(coded, row, n)
    code = coded.indices.to_numpy(zero_copy_only=False)
    same = np.zeros(len(code))
    same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    # properties of each distinct word, then of all words
    bare = pc.match_substring_regex(coded.dictionary, r"^[^A-Za-z0-9\x80-\x{10FFFF}]+$").to_numpy(zero_copy_only=False)[code].astype(float)
    ends = pc.match_substring_regex(coded.dictionary, r"[^A-Za-z0-9.,;:'\"()?\x80-\x{10FFFF}-]$").to_numpy(zero_copy_only=False)[code].astype(float)
    upper = pc.match_substring_regex(coded.dictionary, r"[A-Z]").to_numpy(zero_copy_only=False)[code] & ~pc.match_substring_regex(coded.dictionary, r"[a-z]").to_numpy(zero_copy_only=False)[code]
    lines = pc.split_pattern(col, "\n")
    line_row = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    distinct_lines, _ = _repeats(lines.flatten().dictionary_encode(), line_row, n)
    n_lines = np.maximum(_by_row(line_row, n), 1)
    total = np.maximum(size, 1)
    share = lambda x, y: np.sqrt(np.clip(x / np.maximum(y, 1), 0, 1))
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(sd), share(k["upper"] + k["lower"] + k["high"], total), share(k["upper"], k["upper"] + k["lower"]),
            share(k["digit"], total), share(k["mark"], total), share(k["symbol"], total), share(k["high"], total), np.log1p(k["line"]) - np.log1p(words),
            np.log1p(distinct) - np.log1p(words), share(most, w), share(_by_row(row, n, same), w), share(_by_row(row, n, bare), w), share(_by_row(row, n, ends), w),
            share(_by_row(row, n, upper.astype(float)), w), share(n_lines - distinct_lines, n_lines),
        ]
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, col in text_chunks(batches):
        x = statistics(col)
        offsets = np.arange(len(x) + 1) * x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(x.ravel(), offsets, pa.float64())], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's rows of 1, x and x x', for each class: rows label, at, v."""
    d = len(FEATURES) + 1
    sums = np.zeros((2, d, d))
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        x = batch.column(0).flatten().to_numpy().reshape(-1, d - 1)
        x = np.column_stack((np.ones(len(x)), x))
        for c in (0, 1):
            part = x[label == c]
            sums[c] += part.T @ part
    at = np.arange(d * d)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], d * d).astype(np.int32)), pa.array(np.concatenate((at, at)).astype(np.int32)), pa.array(sums.ravel())], names=["label", "at", "v"])


class Discriminant:
    """Means, Cholesky factors and log-priors of the two classes."""

    def __init__(self, sums: np.ndarray):
        d = sums.shape[1] - 1
        self.known = [bool(s[0, 0] > 0) for s in sums]
        pooled = np.zeros((d, d))
        means, spreads, counts = [], [], sums[:, 0, 0]
        for s in sums:
            n = max(s[0, 0], 1.0)
            mean = s[0, 1:] / n
            spread = s[1:, 1:] / n - np.outer(mean, mean)
            pooled += s[0, 0] * spread
            means.append(mean)
            spreads.append(spread)
        pooled /= max(counts.sum(), 1.0)
        self.means, self.factors, self.offsets = means, [], []
        for n, spread in zip(counts, spreads):
            c = (1 - TO_POOLED) * spread + TO_POOLED * pooled
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(factor))
            self.offsets.append(np.log(max(n, 0.5) / max(counts.sum(), 1.0)) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not all(self.known):  # a class without rows: the other one everywhere, one half without any
            return np.full(len(x), 0.5 if not any(self.known) else float(self.known[1]))
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1) and predicted (1 if score >= THRESHOLD).

    docs needs doc_id and text, labels doc_id and quality (0 or 1; other values and null teach nothing); other
    columns are ignored. A null or empty text is scored like any other, from its zero counts. Rows of one doc_id
    are kept and each scored. Without labels of both classes every score is that of the class there is, or 0.5.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    x = stored(src.mapInArrow(_measured, "doc_id long, x array<double>"), "quality-statistics")
    taught = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    rows = x.where(~held_out()).join(taught, F.col("doc_id") == F.col("id")).select("x", "quality")
    d = len(FEATURES) + 1
    sums = np.zeros((2, d * d))
    # one row for each class and pair of statistics, whatever the number of rows and tasks
    for r in rows.mapInArrow(_moments, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        sums[r["label"], r["at"]] = r["v"]
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(sums.reshape(2, d, d)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(batch.column(2).flatten().to_numpy().reshape(-1, d - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learning from the labels of docs.

    Null and empty texts are scored from their zero counts like any other. Rows that repeat a doc_id stay if one of
    them is accepted; rows without a doc_id, which no score can name, stay. Empty tables are fine on either side;
    other columns pass unchanged.
    """
    good = score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id")
    return docs.join(good, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
