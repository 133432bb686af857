"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

Pieces are dealt to shards of about SHARD pieces by a hash. Each shard is packed by ISLANDS islands, every one with
a population of packings. Crossover puts whole well-filled bins of one parent into the other, takes out the bins
that hold a piece twice, lets bins with room exchange a piece for a larger one or two of the displaced ones, and
best-fits the rest, longest first; an island stops at the least number of bins possible. After each epoch the islands' best
packings move to the next island of the shard. What the shards' least-filled bins hold is dealt anew and packed
once more, so that the rest of a shard does not stay unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_chunks
from .token_ids import TOKENIZER, encode_texts

CAPACITY = 2048
END_ID = 0
SHARD = 4000
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 20
PATIENCE = 4  # generations without a better packing
EXCHANGES = 200  # bins of a child that take part
WELL_FILLED = 0.995
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(name: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            ids, offsets = encode_texts(col, name)
            data = memoryview(np.insert(ids, offsets[1:], end_id).astype("<u4").tobytes())
            offsets = offsets + np.arange(len(offsets))
            n = np.diff(offsets)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * capacity  # the first piece takes what whole sequences leave
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = (offsets[row] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every text (its ids, then end_id), of at most capacity ids; only longer texts are cut."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    return src.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES)


class Packing:
    """Bins of one packing: room[b] is bin b's free space, held[b] its pieces; bins of equal room are found by level."""

    def __init__(self, length: np.ndarray, capacity: int):
        self.length, self.capacity = length, capacity
        self.held: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.level: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.open = 0  # bit r is set if some bin has room r
        self.next = 0

    def add(self, held: list[int], room: int) -> None:
        b = self.next
        self.next += 1
        self.held[b], self.room[b] = held, room
        self._enter(b, room)

    def _enter(self, b: int, room: int) -> None:
        self.level[room].add(b)
        self.open |= 1 << room

    def _leave(self, b: int, room: int) -> None:
        self.level[room].discard(b)
        if not self.level[room]:
            self.open &= ~(1 << room)

    def remove(self, b: int) -> list[int]:
        self._leave(b, self.room.pop(b))
        return self.held.pop(b)

    def best_fit(self, item: int) -> None:
        n = int(self.length[item])
        fits = self.open >> n
        if not fits:
            self.add([item], self.capacity - n)
            return
        room = n + (fits & -fits).bit_length() - 1
        b = min(self.level[room])
        self._leave(b, room)
        self.held[b].append(item)
        self.room[b] = room - n
        self._enter(b, room - n)

    def labels(self) -> np.ndarray:
        out = np.empty(len(self.length), np.int32)
        for k, items in enumerate(self.held.values()):
            out[items] = k
        return out


def fitness(labels: np.ndarray, length: np.ndarray, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins, then bins filled less evenly."""
    fill = np.bincount(labels, weights=length)
    return -len(fill), float(((fill / capacity) ** 2).sum())


def _fresh(length: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    p = Packing(length, capacity)
    for item in np.argsort(-(length * (1 + noise * rng.random(len(length)))), kind="stable").tolist():
        p.best_fit(item)
    return p.labels()


def crossover(mother: np.ndarray, father: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The mother with about a quarter of the father's well-filled bins; displaced pieces are best-fitted."""
    fill = np.bincount(father, weights=length)
    good = np.flatnonzero((fill >= WELL_FILLED * capacity) & (rng.random(len(fill)) < 0.25))
    inside = np.isin(father, good)
    hit = np.zeros(int(mother.max()) + 1, bool)
    hit[mother[inside]] = True
    # a few of the mother's worst bins are opened as well
    waste = capacity - np.bincount(mother, weights=length)
    hit[np.argsort(-waste, kind="stable")[: max(2, len(waste) // 50)]] = True
    stays = ~hit[mother]
    p = Packing(length, capacity)
    for labels, chosen in ((father, inside), (mother, stays & ~inside)):
        items = np.flatnonzero(chosen)
        items = items[np.argsort(labels[items], kind="stable")]
        if len(items):
            for held in np.split(items, np.flatnonzero(np.diff(labels[items])) + 1):
                p.add(held.tolist(), capacity - int(length[held].sum()))
    displaced = np.flatnonzero(~stays & ~inside)
    for item in _exchanged(p, displaced, rng):
        p.best_fit(item)
    return p.labels()


def _exchanged(p: Packing, loose: np.ndarray, rng: np.random.Generator) -> list[int]:
    """Loose pieces, longest first, after some bins with room took one or two of them for a shorter one of theirs.

    A bin gets the largest sum that fits where one of its pieces was, so that bins fill up and what is left over gets
    shorter, which is easier to place.
    """
    loose = loose[np.argsort(p.length[loose], kind="stable")]
    sizes, loose = p.length[loose], loose.tolist()
    left, places = len(loose), np.arange(len(loose))
    with_room = [b for b, r in p.room.items() if r]
    for b in rng.permutation(len(with_room))[:EXCHANGES].tolist():
        b = with_room[b]
        if not loose:
            break
        size = sizes[:left]
        best = None
        for item in p.held[b]:
            n = int(p.length[item])
            room = p.room[b] + n
            one = int(size.searchsorted(room, side="right")) - 1
            if one < 0:
                continue
            if (gain := int(size[one]) - n) > 0 and (best is None or gain > best[0]):
                best = (gain, item, [one])
            short = size[: one + 1]  # no pair holds a longer one
            two = short.searchsorted(room - short, side="right") - 1
            two -= two == places[: one + 1]
            total = short + short[two]
            total[two < 0] = 0
            top = int(total.argmax())
            if (gain := int(total[top]) - n) > 0 and (best is None or gain > best[0]):
                best = (gain, item, [top, int(two[top])])
        if best is None:
            continue
        gain, item, taken = best
        held = p.remove(b)
        room = p.capacity - int(p.length[held].sum()) - gain
        p.add([x for x in held if x != item] + [loose[k] for k in taken], room)
        for k in sorted(taken, reverse=True):
            del loose[k]
            sizes[k : left - 1] = sizes[k + 1 : left]
            left -= 1
        n = p.length[item]
        k = int(sizes[:left].searchsorted(n))
        loose.insert(k, item)
        sizes[k + 1 : left + 1] = sizes[k:left]
        sizes[k] = n
        left += 1
    return loose[::-1]


def least_bins(length: np.ndarray, capacity: int) -> int:
    """A bound that no packing beats: for every size, long pieces need bins of their own, whose room the middling ones fill."""
    x = np.sort(np.asarray(length, np.int64))
    upto = np.concatenate(([0], np.cumsum(x)))
    half = int(np.searchsorted(x, capacity / 2, side="right"))
    sizes = np.concatenate(([0], np.unique(x[:half])))
    low, high = np.searchsorted(x, sizes, side="left"), np.searchsorted(x, capacity - sizes, side="right")
    alone = (high - half) * capacity - (upto[high] - upto[half])
    rest = upto[half] - upto[low] - alone
    return int((len(x) - half + np.maximum(-(-rest // capacity), 0)).max())


def evolve(length: np.ndarray, capacity: int, seed: int, arrived: list[np.ndarray]) -> list[np.ndarray]:
    """One island's epoch: its population, best first."""
    rng = np.random.default_rng(seed)
    rank = lambda x: fitness(x, length, capacity)
    least, still, best = least_bins(length, capacity), 0, None
    people = list(arrived)
    # a packing that meets the bound can't be bettered, so no more are made beside it
    while len(people) < POPULATION and all(-rank(x)[0] > least for x in people):
        people.append(_fresh(length, capacity, rng, 0.0 if not people else 0.15))
    people.sort(key=rank, reverse=True)
    for _ in range(GENERATIONS):
        if -rank(people[0])[0] <= least or still >= PATIENCE:
            break
        children = [crossover(*(people[k] for k in rng.choice(len(people), 2, replace=False)), length, capacity, rng) for _ in range(POPULATION - 1)]
        people = sorted(people + children, key=rank, reverse=True)[:POPULATION]
        still, best = (still + 1, best) if rank(people[0]) == best else (0, rank(people[0]))
    return people


def _epoch(capacity: int, epoch: int, last: bool):
    """Rows of an island: doc_id, piece, key, length, packings (one bin number for each packing that arrived)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, island = (int(k.as_py()) for k in key)
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("key", "ascending")])
        length = group["length"].to_numpy()
        packings = group["packings"].combine_chunks()
        width = len(packings[0])
        arrived = packings.flatten().to_numpy().reshape(-1, width).T if width else []
        arrived = [np.unique(x, return_inverse=True)[1] for x in arrived]
        people = evolve(length, capacity, zlib.crc32(f"{shard}/{island}/{epoch}".encode()), arrived)
        out = people[:1] if last else people[:2]
        flat = np.stack(out, axis=1).astype(np.int32).ravel()
        bins, score = fitness(out[0], length, capacity)
        return pa.table(
            {
                "shard": pa.array(np.full(len(length), shard, np.int64)),
                "island": pa.array(np.full(len(length), island, np.int32)),
                "doc_id": group["doc_id"],
                "piece": group["piece"],
                "key": group["key"],
                "length": group["length"],
                "packings": pa.ListArray.from_arrays(pa.array((np.arange(len(length) + 1) * len(out)).astype(np.int32)), pa.array(flat, pa.int32())),
                "bins": pa.array(np.full(len(length), -bins, np.int32)),
                "score": pa.array(np.full(len(length), score)),
            }
        )

    return run


ISLAND_SCHEMA = "shard long, island int, doc_id long, piece int, key long, length long, packings array<int>, bins int, score double"


def _pack(pieces: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(shard, doc_id, piece, key, length, bin): the best packing of any island of each shard."""
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.lit(shards)), F.lit(shards))
    now = pieces.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "doc_id", "piece", "key", "length")
    now = now.withColumn("packings", F.array().cast("array<int>"))
    for epoch in range(EPOCHS):
        now = stored(now.groupBy("shard", "island").applyInArrow(_epoch(capacity, epoch, epoch == EPOCHS - 1), ISLAND_SCHEMA), "packing-epoch")
        if epoch < EPOCHS - 1:
            # an island keeps its best and gets its neighbour's
            here = now.select("shard", "island", "doc_id", "piece", "key", "length", F.col("packings")[0].alias("own"))
            come = now.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "key", F.col("packings")[0].alias("elite"))
            now = here.join(come, ["shard", "island", "key"]).withColumn("packings", F.array("own", "elite")).drop("own", "elite")
    best = now.groupBy("shard").agg(F.min(F.struct("bins", -F.col("score"), "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    return now.join(best, ["shard", "island"]).select("shard", "doc_id", "piece", "key", "length", F.col("packings")[0].alias("bin"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). Repeated rows are each packed.

    Pieces of exactly capacity are sequences of their own. An empty table gives an empty result; the order of equal
    pieces is that of (doc_id, piece), then that in which they are written. The least-filled bins of all shards are packed a second time together.
    """
    columns = pieces.columns
    pieces = stored(pieces.withColumn("key", F.monotonically_increasing_id()), "packing-pieces")  # a written row's number stays
    whole = pieces.where(F.col("length") >= capacity)
    parts = pieces.where(F.col("length") < capacity).select("doc_id", "piece", "key", "length")
    n = parts.count()
    first = stored(_pack(parts, max(1, -(-n // shard)), capacity), "packing-first")
    fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    loose = F.col("fill") < WELL_FILLED * capacity
    again = stored(first.join(fill.where(loose), ["shard", "bin"]).select("doc_id", "piece", "key", "length"), "packing-loose")
    n = again.count()
    second = _pack(again, max(1, -(-n // (4 * shard))), capacity)
    kept = first.join(fill.where(~loose), ["shard", "bin"])
    number = lambda kind: (F.col("shard") * (1 << 32) + F.col("bin")) * 4 + kind
    placed = kept.select("doc_id", "piece", "key", "length", number(0).alias("sequence_id")).union(second.select("doc_id", "piece", "key", "length", number(1).alias("sequence_id")))
    inside = F.sum("length").over(_before())
    placed = placed.select("key", "sequence_id", F.coalesce(inside, F.lit(0)).alias("offset"))
    alone = whole.select(*columns, (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed, "key").select(*columns, "sequence_id", "offset").union(alone)


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "key").rowsBetween(Window.unboundedPreceding, -1)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, as op10 gives them.

    A null, empty or blank text has its ids and end like any other; rows without a doc_id have no piece; repeated rows
    are each packed; an empty table gives an empty result; other columns are not read.
    """
    return pack(cut_pieces(docs))
