"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark, merged into removal intervals.

Every window of every text is hashed. A window can only repeat if the rarest-hash short run inside it (its anchor,
the smallest Rabin-Karp hash among the runs of ANCHOR words that start in it) repeats too, so anchors, about one
for 14 words, are counted first, and only windows whose anchor occurs twice are counted themselves. That is exact:
two equal windows choose the same anchor. Texts with the same words all over are settled as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, join_by_parts, list_array, prune_by_ids, rolling, sorted_unique, split_words, stored, table, text_chunks, window_starts, word_hashes

WINDOW = 35
ANCHOR = 8
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
KEY = ["doc_id", "text_key"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _text_key(text: Column) -> Column:
    """With the doc_id it names a row; only repeated rows, which all fare alike, have the same."""
    return F.xxhash64(text.cast("string"))


def _anchor_of(words: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window start, the word position of its anchor."""
    if not len(starts):
        return starts
    return _first_least(rolling(words, anchor, BASES[1]), window - anchor + 1)[starts]


def _first_least(x: np.ndarray, span: int) -> np.ndarray:
    """The place of the first smallest value in each stretch of span values, by stretches of doubling width."""
    at, width = np.arange(len(x), dtype=np.int32), 1
    better = lambda a, b: np.where(x[b] < x[a], b, a)
    while 2 * width <= span:
        at = better(at[:-width], at[width:])
        width *= 2
    rest = span - width
    return (better(at[: len(at) - rest], at[rest:]) if rest else at).astype(np.int64)


def _joined(flat: pa.Array, offsets: np.ndarray) -> list[str]:
    words = flat.to_pylist()
    return [" ".join(words[a:b]) for a, b in zip(offsets, offsets[1:])]


def _scan(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            flat, offsets = split_words(col)
            (words,) = word_hashes(flat, 1)
            at = sorted_unique(_anchor_of(words, window_starts(offsets, window), window, anchor))
            runs = rolling(words, anchor, BASES[0])[at].view(np.int64) if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s in _joined(flat, offsets)]),
                    list_array(runs, np.searchsorted(at, offsets), pa.int64()),
                    batch.column(2),
                ],
                names=["doc_id", "n_words", "sha", "anchors", "text_key"],
            )

    return run


def _windows(window: int, anchor: int):
    """Windows whose anchor is among the row's repeated anchors (their ordinals among the row's anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            flat, offsets = split_words(col)
            first, second = word_hashes(flat, 1, 2)
            starts = window_starts(offsets, window)
            anchors = _anchor_of(first, starts, window, anchor)
            at = sorted_unique(anchors)
            wanted = batch.column(2)
            counts = np.diff(wanted.offsets.to_numpy())
            ordinal = wanted.flatten().to_numpy() + np.repeat(np.searchsorted(at, offsets[:-1]), counts)
            good = np.zeros(len(at), bool)
            good[ordinal] = True
            starts = starts[good[np.searchsorted(at, anchors)]]
            row = np.searchsorted(offsets, starts, side="right") - 1
            a = rolling(first, window, BASES[0])[starts] if len(starts) else np.empty(0, np.uint64)
            b = rolling(second, window, BASES[1])[starts] if len(starts) else np.empty(0, np.uint64)
            for i in range(0, len(starts), 1 << 17):
                s = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[s].view(np.int64)), pa.array(b[s].view(np.int64)), batch.column(0).take(pa.array(row[s])), pa.array((starts[s] - offsets[row[s]]).astype(np.int32)), batch.column(3).take(pa.array(row[s]))],
                    names=["h1", "h2", "doc_id", "pos", "text_key"],
                )

    return run


def _cut(window: int):
    """Applies the windows to remove: covered words go, the rest is joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            flat, offsets = split_words(col)
            starts = batch.column(2)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts.offsets.to_numpy()))
            begin = starts.flatten().to_numpy() + offsets[row]
            depth = np.zeros(len(flat) + 1, np.int32)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + window, -1)
            keep = np.cumsum(depth)[:-1] == 0
            kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
            texts = _joined(flat.filter(pa.array(keep)), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets) - np.diff(kept)),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s in texts]),
                    pa.array(texts, pa.string()),
                    batch.column(3),
                ],
                names=["doc_id", "n_removed", "kept_sha256", "kept_text", "text_key"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Finds and cuts the words covered by windows of `window` words that start more than once in docs.

    docs needs doc_id (rows without one take no part) and text; other columns are ignored. Returns (summary, cut).
    summary: doc_id, n_words, n_removed, kept_sha256 for every row; cut: doc_id, text_key, kept_text, once for the
    rows that lost words and are alike in doc_id and text. A null or empty text has no words; texts shorter than the
    window lose nothing; an empty table gives empty results. Rows with the same words, repeated rows among them, are
    all removed if they hold a window.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), _text_key(F.col("text")).alias("text_key")).where(F.col("doc_id").isNotNull())
    scan = stored(src.mapInArrow(_scan(window, anchor), "doc_id long, n_words long, sha string, anchors array<long>, text_key long"), "substring-scan")
    classes = stored(scan.where(f"n_words >= {window}").groupBy("sha").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("n")).where("n > 1"), "substring-classes")
    copied = stored(join_by_parts(scan.select(*KEY, "sha"), classes.select("sha", "n"), ["sha"], KEY).select(*KEY), "substring-copied")
    first = classes.select("first.*")
    # of texts with the same words, all but the first are settled and take no further part
    rest = scan.select(*KEY, "anchors").join(copied.join(first, KEY, "left_anti"), KEY, "left_anti")
    occurrences = stored(rest.select(*KEY, F.posexplode("anchors").alias("pos", "h")), "substring-anchors")
    repeated = stored(occurrences.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "substring-repeated")
    wanted = stored(join_by_parts(occurrences, repeated, ["h"], [*KEY, "pos"]).groupBy(*KEY).agg(F.collect_set("pos").alias("wanted")), "substring-wanted")
    drop_stored(occurrences, repeated)
    near = prune_by_ids(src, wanted.select("doc_id"), "doc_id").join(wanted, KEY).select("doc_id", "text", "wanted", "text_key")
    windows = stored(near.mapInArrow(_windows(window, anchor), "h1 long, h2 long, doc_id long, pos int, text_key long"), "substring-windows")
    twice = stored(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "substring-twice")
    starts = stored(
        join_by_parts(windows, twice, ["h1", "h2"], [*KEY, "pos"]).join(copied, KEY, "left_anti").groupBy(*KEY).agg(F.collect_list("pos").alias("starts")),
        "substring-starts",
    )
    drop_stored(windows, wanted, twice)
    hit = prune_by_ids(src, starts.select("doc_id"), "doc_id").join(starts, KEY).select("doc_id", "text", "starts", "text_key")
    cut = stored(hit.mapInArrow(_cut(window), "doc_id long, n_removed long, kept_sha256 string, kept_text string, text_key long"), "substring-cut")
    once = copied.distinct()
    gone = once.select(*KEY, F.lit(None).cast("long").alias("n_removed"), F.lit(EMPTY_SHA256).alias("kept_sha256"))
    changed = cut.select(*KEY, "n_removed", "kept_sha256").union(gone)
    changed = changed.select(*KEY, F.coalesce("n_removed", F.lit(-1)).alias("lost"), F.col("kept_sha256").alias("new_sha"))
    summary = scan.select(*KEY, "n_words", "sha").join(changed, KEY, "left").select(
        "doc_id",
        "n_words",
        F.expr("case when lost is null then 0 when lost < 0 then n_words else lost end").alias("n_removed"),
        F.coalesce("new_sha", "sha").alias("kept_sha256"),
    )
    return summary, cut.select(*KEY, "kept_text").union(once.select(*KEY, F.lit("").alias("kept_text")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))[0]


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that loses its last word goes, all others keep their columns.

    Null, empty and blank texts, and texts shorter than a window, stay as they are, as do rows without a doc_id, whose
    text is not compared. Repeated rows hold each other's passages and lose them. n_chars is that of the text left; an
    empty table gives an empty one.
    """
    _, cut = remove_repeats(docs)
    cut = cut.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("kept_text").alias("__kept"))
    joined = docs.join(cut, (docs["doc_id"] == F.col("__id")) & (_text_key(docs["text"]) == F.col("__key")), "left")
    text = F.coalesce(F.col("__kept"), docs["text"])
    gone = F.col("__kept").isNotNull() & (F.length("__kept") == 0)
    out = [text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.where(~gone).select(*out)
