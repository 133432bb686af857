"""Periodic runs of words by recursive frequency splitting and a scan of lags.

A run is a stretch of words with smallest period q, at least max(SHORTEST, POWER q) long, that no neighbour extends.
Each of its words occurs POWER times in it or more, so a word that occurs less often in a segment is in no run there
and splits it; the pieces are counted anew, until every word left is frequent enough within its own segment.
The segments that survive are scanned lag by lag. A run of period q holds POWER places in a row that are multiples of
q (counted from the segment's start) with one word on them, so each lag looks only at its multiples, n / q places;
where they and a few words between them agree, the run is extended to both sides. Lags ascend, and what lies within
a run that is known needs no second look, so the scan takes about n log n steps however periodic a text is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words, table, text_chunks

POWER = 4
SHORTEST = 6
MOST_PASSES = 64  # then segments are scanned as they are: the scan needs no splitting to be right
SLICE = 1 << 22
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _places(begin: np.ndarray, count: np.ndarray, step: np.ndarray | int = 1) -> np.ndarray:
    """For each begin, count places from it on, step apart; one after the other."""
    ordinal = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(begin, count) + ordinal * (np.repeat(step, count) if isinstance(step, np.ndarray) else step)


def frequent_segments(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments in which every word occurs POWER times or more."""
    begin, end, size = offsets[:-1], offsets[1:], int(code.max()) + 1 if len(code) else 1
    settled = []
    for turn in range(MOST_PASSES + 1):
        long = end - begin >= SHORTEST
        begin, end = begin[long], end[long]
        if not len(begin) or turn == MOST_PASSES:
            break
        n = end - begin
        at, segment = _places(begin, n), np.repeat(np.arange(len(begin)), n)
        _, which, count = np.unique(segment * size + code[at], return_inverse=True, return_counts=True)
        rare = count[which] < POWER
        whole = np.bincount(segment[rare], minlength=len(begin)) == 0
        settled.append((begin[whole], end[whole]))
        stays = ~rare & ~whole[segment]
        at, segment = at[stays], segment[stays]
        apart = np.flatnonzero((np.diff(at) != 1) | (np.diff(segment) != 0)) + 1
        begin, end = at[np.concatenate(([0], apart))] if len(at) else at, at[np.append(apart - 1, len(at) - 1)] + 1 if len(at) else at
    settled.append((begin, end))
    return np.concatenate([b for b, _ in settled]), np.concatenate([e for _, e in settled])


def _agree(code: np.ndarray, low: int, high: int, q: int, forward: bool) -> int:
    """How many places from low on (or back from high - 1) have the same word as the place q after them."""
    seen, width = 0, 64
    while low < high:
        a, b = (low, min(high, low + width)) if forward else (max(low, high - width), high)
        differ = np.flatnonzero(code[a:b] != code[a + q : b + q])
        if len(differ):
            return seen + (int(differ[0]) if forward else b - a - 1 - int(differ[-1]))
        seen += b - a
        low, high = (b, high) if forward else (low, a)
        width *= 2
    return seen


def scan_lags(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs within the segments, by period and start."""
    found: list[tuple[int, int, int]] = []
    known = np.zeros(len(code), np.int64)  # where the farthest run that covers a place ends
    seen: set[tuple[int, int]] = set()
    q = 1
    while True:
        long = end - begin >= POWER * q
        begin, end = begin[long], end[long]
        if not len(begin):
            return found
        # every lag from q to 2 q - 1 of every segment that has room for it; no run's multiple is in its own group
        most = np.minimum((end - begin) // POWER, 2 * q - 1) - q + 1
        owner, lag = np.repeat(np.arange(len(begin)), most), _places(np.full(len(begin), q), most)
        tries = (end[owner] - begin[owner] - 1) // lag - POWER + 2
        part = (np.cumsum(tries) - tries) // SLICE
        ends: dict[tuple[int, int], int] = {}
        for mine in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(part)) + 1):
            for i, d, o in _anchors(code, begin, owner[mine], lag[mine], tries[mine], known):
                if i < ends.get((o, d), 0) or known[i] > i + (POWER - 1) * d:
                    continue
                b, e = int(begin[o]), int(end[o])
                start = i - _agree(code, b, i, d, False)
                stop = i + _agree(code, i, e - d, d, True) + d
                ends[o, d] = stop - d  # a stretch of the same lag can begin within the last period of this one
                if stop - start >= max(SHORTEST, POWER * d) and (start, stop) not in seen:
                    seen.add((start, stop))
                    found.append((start, stop, d))
                    np.maximum(known[start:stop], stop, out=known[start:stop])
        q *= 2


def _anchors(code: np.ndarray, begin: np.ndarray, owner: np.ndarray, lag: np.ndarray, tries: np.ndarray, known: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, lag, segment) where POWER multiples of a lag in a row, and places between them, hold the same words."""
    at, d, o = _places(begin[owner], tries, lag), np.repeat(lag, tries), np.repeat(owner, tries)
    for k in range(1, POWER):
        same = code[at] == code[at + k * d]
        at, d, o = at[same], d[same], o[same]
    for offset in (lambda x: np.minimum(1, x - 1), lambda x: x // 2, lambda x: x - 1):
        x = at + offset(d)
        same = (code[x] == code[x + d]) & (code[x] == code[x + 2 * d])
        at, d, o = at[same], d[same], o[same]
    new = known[at] <= at + (POWER - 1) * d
    at, d, o = at[new], d[new], o[new]
    if len(at) and d[0] == 1:  # single words repeated: the first place of each stretch stands for it
        first = (d > 1) | np.concatenate(([True], (at[1:] != at[:-1] + 1) | (o[1:] != o[:-1]) | (d[1:] != d[:-1])))
        at, d, o = at[first], d[first], o[first]
    order = np.lexsort((at, d))
    return list(zip(at[order].tolist(), d[order].tolist(), o[order].tolist()))


def periodic_tail(key: str, n: int) -> tuple[int, int] | None:
    """(a, p) if the words of the document from a on are to repeat its p words from a: one document of ten."""
    h = zlib.crc32(key.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _found(tails: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            flat, offsets = split_words(col)
            coded = flat.dictionary_encode()
            code, source = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(flat))
            if tails:
                for i, (key, o, e) in enumerate(zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())):
                    planted = None if key is None else periodic_tail(str(key), e - o)
                    if planted:
                        a, p = planted
                        source[o + a : e] = o + a + np.arange(e - o - a) % p
                code = code[source]
            runs = sorted((s, q, e) for s, e, q in scan_lags(code, *frequent_segments(code, offsets)))
            drop = np.zeros(len(code) + 1, np.int32)
            for s, q, e in runs:
                drop[s + q] += 1
                drop[e] -= 1
            kept = np.cumsum(drop)[:-1] == 0
            upto = np.concatenate(([0], np.cumsum(kept)))[offsets].tolist()
            words = coded.dictionary.take(pa.array(code[kept])).to_pylist()
            row = np.searchsorted(offsets, [s for s, _, _ in runs], side="right") - 1
            first = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            out = []
            for i in range(batch.num_rows):
                mine = [(s - int(offsets[i]), e - s, q) for s, q, e in runs[first[i] : first[i + 1]]]
                best = None
                for r in mine:  # by start, then period: the first of equal ones stays
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest()
                text = hashlib.sha256(" ".join(words[upto[i] : upto[i + 1]]).encode()).hexdigest()
                n = int(offsets[i + 1] - offsets[i])
                out.append((len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, text, n, n - upto[i + 1] + upto[i]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """Per row of docs: its number of runs, the run of greatest length / period, digests of all runs and of the words kept.

    Words are maximal stretches without the white space \\x20, \\x09-\\x0D. A word is dropped if a run contains it after
    that run's first period. Ties for the greatest run go to the smaller start, then the smaller period; without runs
    its columns are null. docs needs doc_id and text; other columns are ignored. A null, empty or blank text has no
    words and no runs; rows without a doc_id and repeated rows are each given; an empty table gives an empty result.
    A text is looked at as a whole by the task that reads it, in memory that grows with its length. With `tails`,
    the end of one document in ten is first made periodic (see periodic_tail), which rows without a doc_id are not.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_found(tails), SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), tails=True)
