"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Texts and items are compared as bytes with ASCII and Latin-1 letters in lower case and all white space as spaces. An item of
m bytes that lies in a text with at most k edits shares at least T = m - q + 1 - k q of its q-grams with it, on
diagonals (place in the text less place in the item) that differ by at most k. Of its rarest q-grams that do not
overlap, k + 3 are looked up in the texts; where 3 of them lie in a band of diagonals, all shared q-grams are counted
in that band (bands overlap by half); bands reaching T are verified by an alignment of width 2 k + 1. Texts are
looked at in stretches, and what they hit in parts, so memory has a bound whatever the items and texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_chunks
from .quality import _bytes_of

Q = 8
EDIT_SHARE = 0.06
BLOCK_BYTES = 4 << 20
SIEVE_BITS = 22
TOGETHER = 3  # probes that have to lie in a band, if an item has room for as many
STRETCH = 1 << 20
MOST_HITS = 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 32
    fold[9:14] = 32
    return fold


_FOLD = _fold()


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case and white space as spaces; no byte moves."""
    out = _FOLD[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 0x20
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes at every place as one number."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    two = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
    four = (two[:-2].astype(np.uint32) << np.uint32(16)) | two[2:]
    return (four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:]


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)


def edits_allowed(m: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """The edit budget of an item of m bytes: the share, lowered where the lemma would then ask for no shared q-gram."""
    return max(0, min(int(share * m), (m - q) // q))


class Items:
    """The items of one block: their bytes, and for each its probes, some of its rarest q-grams that do not overlap.

    k edits change at most k of k + s q-grams that do not overlap, so an occurrence holds s of an item's probes, on
    diagonals that differ by at most k. Only where they are found together are all q-grams counted.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.data = [fold(np.frombuffer(t.strip().encode(), np.uint8)) for _, t in rows]
        self.size = np.array([len(x) for x in self.data], np.int64)
        self.edits = np.array([edits_allowed(int(m)) for m in self.size], np.int64)
        self.needed = np.maximum(self.size - Q + 1 - self.edits * Q, 1)
        self.together = np.clip(self.size // Q - self.edits, 1, TOGETHER)
        keys = np.concatenate([np.empty(0, np.uint64), *map(grams, self.data)])
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = count[which]  # in the items, which stands for how often a q-gram is in texts like them
        item, place = [], []
        end = np.cumsum(np.maximum(self.size - Q + 1, 0))
        for i, m in enumerate(self.size.tolist()):
            if m >= Q:
                found = self._probes(often[end[i] - m + Q - 1 : end[i]], int(self.edits[i] + self.together[i]), m)
                place.append(found)
                item.append(np.full(len(found), i))
        self.item = np.concatenate(item) if item else np.empty(0, np.int64)
        self.place = np.concatenate(place) if place else np.empty(0, np.int64)
        keys = keys[(end - np.maximum(self.size - Q + 1, 0))[self.item] + self.place]
        order = np.lexsort((self.item, keys))
        self.keys, self.item, self.place = keys[order], self.item[order], self.place[order]
        first = np.concatenate((np.ones(min(len(keys), 1), bool), self.keys[1:] != self.keys[:-1]))
        self.distinct, self.rank = self.keys[first], np.cumsum(first) - 1
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[slots(self.distinct)] = True
        self.reach = int((self.size + 3 * self.edits).max()) + 2 if len(rows) else 0

    @staticmethod
    def _probes(often: np.ndarray, probes: int, m: int) -> np.ndarray:
        """In each of so many equal parts of an item, the place of its rarest q-gram."""
        part = m // probes
        starts = np.arange(probes) * part
        return starts + often[starts[:, None] + np.arange(part - Q + 1)].argmin(axis=1)

    def search(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of the items found in rows of folded bytes."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # rows go together as long as they are short; a long one is looked at in pieces that overlap by an item's reach
        for low, high in self._stretches(edges):
            for r, i, b in self._candidates(data[low:high], np.clip(edges - low, 0, high - low)):
                k = int(self.edits[i])
                text, item = data[edges[r] : edges[r + 1]], self.data[i]
                # the band's smallest diagonal, in the row
                first = (b - 1) * (k + 1) - len(item) + max(low - int(edges[r]), 0)
                if self._shared(text, i, first) < self.needed[i]:
                    continue
                a = max(0, first - k)
                z = min(len(text), first + 2 * (k + 1) + len(item) + k)
                got = banded(item, text[a:z], k, first - a)
                if got and ((r, i) not in best or (got[0], got[1] + a) < best[r, i][:2]):
                    best[r, i] = (got[0], got[1] + a, got[2] + a)
        for (r, i), (distance, start, end) in sorted(best.items()):
            yield r, i, distance, start, end

    def _stretches(self, edges: np.ndarray) -> Iterator[tuple[int, int]]:
        at, n = 0, len(edges) - 1
        while at < n:
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + STRETCH, side="right")) - 1)
            low, high = int(edges[at]), int(edges[upto])
            while high - low > STRETCH + self.reach:
                yield low, low + STRETCH + self.reach
                low += STRETCH
            yield low, high
            at = upto

    def _candidates(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, band) where enough of an item's probes lie in a band of diagonals of width 2 k + 2."""
        keys = grams(data)
        if not len(keys) or not len(self.distinct):
            return
        at = np.flatnonzero(self.sieve[slots(keys)])
        rank = np.minimum(np.searchsorted(self.distinct, keys[at]), len(self.distinct) - 1)
        same = self.distinct[rank] == keys[at]
        at, rank = at[same], rank[same]
        row = np.searchsorted(edges, at, side="right") - 1
        inside = at + Q <= edges[row + 1]
        at, rank, row = at[inside], rank[inside], row[inside]
        if not len(at):
            return
        n, posted = len(self.ids), self.rank * len(self.ids) + self.item
        total = int((np.searchsorted(self.rank, rank, side="right") - np.searchsorted(self.rank, rank)).sum())
        parts = min(n, -(-total // MOST_HITS))
        for low, high in zip(np.arange(parts) * n // parts, np.arange(1, parts + 1) * n // parts):
            begin, end = np.searchsorted(posted, rank * n + low), np.searchsorted(posted, rank * n + high)
            yield from self._in_bands(begin, end - begin, at, row, edges)

    def _in_bands(self, begin: np.ndarray, many: np.ndarray, at: np.ndarray, row: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        index = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        if not len(index):
            return
        item, row = self.item[index], np.repeat(row, many)
        diagonal = np.repeat(at, many) - self.place[index] - edges[row]
        step = self.edits[item] + 1
        # bands are not negative; row, item and band are one number, so its room is that of the bands really present
        span = int(((diagonal + self.size[item]) // step).max()) + 2
        found = []
        for shift in (0, 1):  # bands of width 2 k + 2 that overlap by half
            band = (diagonal + self.size[item]) // step + shift
            group = (row * len(self.ids) + item) * span + band
            # a probe of the item counts once in a band
            order = np.lexsort((self.place[index], group))
            g, p = group[order], self.place[index][order]
            fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])))
            found.append(g[fresh])
        which, count = np.unique(np.concatenate(found), return_counts=True)
        item = which // span % len(self.ids)
        good = count >= self.together[item]
        yield from zip((which[good] // span // len(self.ids)).tolist(), item[good].tolist(), (which[good] % span).tolist())

    def _shared(self, text: np.ndarray, i: int, first: int) -> int:
        """How many q-grams of item i the text holds on the diagonals from first to first + 2 k + 1."""
        own, width = grams(self.data[i]), 2 * int(self.edits[i]) + 2
        a, z = max(0, first), min(len(text), first + width - 1 + len(self.data[i]))
        there = grams(text[a:z])
        shared = np.zeros(len(own), bool)
        for d in range(first, first + width):
            low, high = max(0, a - d), min(len(own), len(there) + a - d)
            if low < high:
                shared[low:high] |= own[low:high] == there[low + d - a : high + d - a]
        return int(shared.sum())


def banded(item: np.ndarray, text: np.ndarray, k: int, first: int) -> tuple[int, int, int] | None:
    """The best alignment of item inside text with at most k edits, on diagonals from first - k to first + 3 k + 1.

    Returns (edits, start, end); of equal ones that on the first diagonal. For each number of edits in turn, every
    diagonal of the band gets the furthest place in the item that is reached: one edit from itself or a neighbour,
    then on over equal bytes. Places beside the text differ from every byte.
    """
    m, n, low, width = len(item), len(text), first - k, 4 * k + 2
    left, right = max(0, -low), max(0, low + width + m - n)
    padded = np.concatenate((np.full(left, 256, np.uint16), text, np.full(right, 256, np.uint16)))
    differ = sliding_window_view(padded, m)[low + left : low + left + width] != item
    places = np.where(differ, np.arange(m, dtype=np.int32), np.int32(m))
    following = np.full((width, m + 1), m, np.int32)
    following[:, :m] = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(width)
    reach, start = following[:, 0], low + rows
    for edits in range(k + 1):
        done = np.flatnonzero(reach >= m)
        if len(done):
            return edits, max(0, int(start[done[0]])), min(n, m + low + int(done[0]))
        changed = reach + 1
        added, begun_a = np.append(-1, reach[:-1]), np.append(0, start[:-1])
        lacking, begun_l = np.append(reach[1:] + 1, -1), np.append(start[1:], 0)
        best = np.maximum(changed, np.maximum(added, lacking))
        start = np.where(best == changed, start, np.where(best == added, begun_a, begun_l))
        reach = following[rows, np.minimum(best, m)]
    return None


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch, col in text_chunks(batches):
            data, edges = _bytes_of(col)
            rows = list(items.search(fold(data), edges))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["doc_id", "item_id", "distance", "start", "end"],
            )

    return run


def find_leaks(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document and item found in it: doc_id, item_id, distance (edits), start and end (bytes in the text).

    docs needs doc_id and text, items item_id and text; other columns are ignored, as are rows without an id. Null,
    empty and blank texts hold nothing; items of fewer than Q bytes are no evidence and match nothing. Of an item's
    occurrences in a document the one with fewest edits is given, of equal ones the first. Repeated rows are each
    searched. Items go to the tasks in blocks of about block_bytes (dealt by a hash of their ids); every block is
    a pass over docs, and only one block at a time is on the driver.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    known = items.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        return _found(src, known, spark)
    # one block after the other is on the driver and in the tasks; what it finds is written before the next one comes
    found = []
    for b in range(blocks):
        found.append(stored(_found(src, known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), spark), "leaks-block"))
    return reduce(DataFrame.union, found)


def _found(src: DataFrame, items: DataFrame, spark: SparkSession) -> DataFrame:
    shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in items.collect()]))
    return src.mapInArrow(_scan(shared), SCHEMA)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null, empty and blank texts hold nothing and stay, as do rows without a doc_id, whose text is not searched; rows
    that repeat a doc_id go if one of them holds an item. Empty tables on either side drop nothing; other columns pass.
    """
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
