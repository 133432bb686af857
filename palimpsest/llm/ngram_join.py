"""N-gram Jaccard join: documents whose word-shingle sets are similar, found by T-occurrence search (DivideSkip).

Plan, with sizes n and threshold t = num/den:
1. Each text becomes its set of hashed shingles. Equal sets form one class and are represented by one row, with a
   parity bitmap of about 2 n bits, from which an upper bound of any two sets' overlap follows.
2. In how many classes each shingle is, is counted: chunks of sets send their distinct shingles to buckets of hashes,
   which send back those of several classes with their counts. That gives one order for all sets, rarest first.
3. Two linked sets share, of the first n - ceil(t n) + k shingles of each, at least k (k grows with n), the first of
   them among the first n - ceil(t n) + 1, its keys. The inverted lists are those of the keys, by sizes that can link.
4. Posters of a list of over GROUP sets are first held exactly against the list's smallest one, its leader, which
   joins large groups of near copies in one row for each, not in all pairs.
5. Every list whose posters are not all connected goes to a T-occurrence search over the posted shingles: short lists
   are merged with a heap, long ones probed by binary search. Sets found on k lists, not connected, and near enough
   by their bitmaps are compared as a whole, until all are connected, so that there are fewer links than sets. Lists
   of one leader are searched together; the sets they list are dealt to parts of PART, those outside the leader's
   component, which ask, to blocks of PART, and each block meets each part: no task holds more than 2 PART of a group.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_size, components, drop_stored, give_back, in_bitmap, list_array, mix64, prune_by_ids, slot_bitmap, sorted_unique, split_words, stored, table, text_chunks, window_starts, word_hashes

GROUP = 64
PART = 512
PAIRS = 4096
RESERVE = 20
KEY = ["n_shingles", "s1", "s2"]  # names a set
SCAN = "doc_id long, n_shingles long, s1 long, s2 long"
SETS = f"{SCAN}, items binary, bits binary"
DEAL_SHINGLES = 400_000
BUCKET_SHINGLES = 500_000
OWNERS_SENT = 16
HEAD = "doc_ids binary, sizes binary, ones binary, twos binary, often binary, often_held binary, often_owners binary"
BLOCK = f"chunk long, bucket int, hashes binary, held binary, sent binary, owners binary, {HEAD}"
COUNTED = f"chunk long, hashes binary, ranks binary, sent binary, owners binary, {HEAD}"
POSTED = f"{SCAN}, n_keys int, posted array<long>"
names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def _shingles(col: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes in order."""
    flat, offsets = split_words(col, lower)
    (words,) = word_hashes(flat, 3)
    starts = window_starts(offsets, n)
    mixed = np.zeros(len(starts), np.uint64)
    for j in range(n):
        if len(starts):
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + words[starts + j])
    at = np.concatenate(([0], np.cumsum(np.maximum(np.diff(offsets) - n + 1, 0))))
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        if b - a >= n:
            yield sorted_unique(mixed[at[i] : at[i + 1]])
        elif b > a:  # fewer words than a shingle has: the whole sequence, told apart by its length
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + w)
            yield whole
        else:
            yield np.empty(0, np.uint64)


def shared_least(n):
    """k: how many posted shingles a set of n shares with any linked one that is not smaller."""
    return 1 + n // RESERVE


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of how many of a set's hashes fall on each bit; 64 bits or more, a power of two from 2 n on."""
    size = max(64, 1 << int(2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits(np.bincount((mix64(hashes) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def most_shared(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """No two sets of n and m with these bitmaps share more: bits that differ stand for shingles that only one has."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


def _may_link(a: np.ndarray, b: np.ndarray, n: int, m: int, num: int, den: int) -> bool:
    if num * max(n, m) > den * min(n, m):
        return False
    most = most_shared(a, b, n, m)
    return den * most >= num * (n + m - most)


def _named(hashes: np.ndarray) -> tuple[int, int, int]:
    """What names a set: its size and two sums over its hashes."""
    mixed = mix64(hashes)
    return len(hashes), int(np.sum(mixed, dtype=np.uint64).view(np.int64)), int(np.sum(mix64(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64).view(np.int64))


def _scan(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            known = np.array([_named(x) for x in _shingles(col, n)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(known[:, i]) for i in range(3))], names=names(SCAN))

    return run


def _scan_texts(n: int):
    """As _scan, with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            known = np.array([_named(x) for x in _shingles(col, n)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(known[:, i]) for i in range(3)), batch.column(1)], names=[*names(SCAN), "text"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches):
            sets = list(_shingles(col, n))
            known = np.array([_named(x) for x in sets], np.int64).reshape(-1, 3)
            columns = [*(pa.array(known[:, i]) for i in range(3)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([bitmap(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names(SETS))

    return run


def _numbers(col: pa.ChunkedArray, kind) -> np.ndarray:
    """All numbers of a column of packed numbers, row after row."""
    return np.frombuffer(b"".join(x for x in col.to_pylist() if x), kind)


def _six(values: np.ndarray) -> np.ndarray:
    """Numbers below 2**48 as rows of six bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(col: pa.ChunkedArray) -> np.ndarray:
    packed = _numbers(col, np.uint8).reshape(-1, 6)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :6] = packed
    return out.view("<u8").ravel()


def _deal(n: int, buckets: int, out, back):
    """Rows doc_id, text -> blocks: the distinct shingles of a chunk of sets, dealt to buckets by ranges of hashes.

    Sets whose slot is in the bitmap `out`, but not in `back`, stay out. A block holds the first 48 bits of the
    shingles' hashes in order (equal ones of unlike shingles would only add to a count), in how many of the chunk's
    sets each is, and in which (by ordinal). Where those are over OWNERS_SENT they stay out of the block, which so has
    a bounded size for each chunk, and travel with one block of the chunk to where its sets are put together again,
    as do the names of the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        for batch, col in text_chunks(batches):
            sets = list(_shingles(col, n))
            known = np.array([_named(x) for x in sets], np.int64).reshape(-1, 3)
            ids = batch.column(0).to_numpy()
            stays = (known[:, 0] > 0) & (~in_bitmap(out.value, _slots(ids, known[:, 1], len(out.value) * 8)) | in_bitmap(back.value, _slots(ids, known[:, 2], len(back.value) * 8)))
            rows = np.flatnonzero(stays)
            size = known[rows, 0]
            part = (np.cumsum(size) - size) // DEAL_SHINGLES
            for at in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
                if len(at):
                    yield _blocks(first + made, [sets[i] for i in at.tolist()], ids[at], known[at], buckets)
                    made += 1

    return run


def _slots(ids: np.ndarray, sums: np.ndarray, bits: int) -> np.ndarray:
    return (ids ^ sums) & (bits - 1)


def _blocks(chunk: int, sets: list[np.ndarray], ids: np.ndarray, known: np.ndarray, buckets: int) -> pa.RecordBatch:
    values = np.concatenate(sets) >> np.uint64(16)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), known[:, 0])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    held = np.diff(np.append(at, len(values)))
    distinct = values[at]
    here = held > OWNERS_SENT
    often = np.repeat(here, held)
    sent = np.where(here, 0, held)
    bucket = ((distinct >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    some, six = owner[~often], _six(distinct)
    upto = np.concatenate(([0], np.cumsum(sent)))
    packed = [[], [], [], []]
    for a, b in zip(cuts, cuts[1:]):
        for into, x in zip(packed, (six[a:b], held[a:b].astype(np.uint32), sent[a:b].astype(np.uint8), some[upto[a] : upto[b]])):
            into.append(x.tobytes())
    head = [ids, known[:, 0], known[:, 1], known[:, 2], six[here], held[here].astype(np.uint32), owner[often]]
    count = len(cuts) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, chunk)), pa.array(bucket[cuts[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed), *(pa.array([x.tobytes(), *[None] * (count - 1)], pa.binary()) for x in head)],
        names=names(BLOCK),
    )


def _count(group: pa.Table) -> pa.Table:
    """A bucket's blocks with the rank of each shingle's count over all sets; shingles of a single set are left out."""
    hashes, held = _from_six(group["hashes"]), _numbers(group["held"], np.uint32)
    sent, owners = _numbers(group["sent"], np.uint8), _numbers(group["owners"], np.uint16)
    _, which = np.unique(hashes, return_inverse=True)
    count = np.bincount(which, weights=held)
    ranks = np.minimum(np.floor(4 * np.log2(count)), 255).astype(np.uint8)[which]
    keep = count[which] > 1
    keep_owner = np.repeat(keep, sent)
    edges = np.concatenate(([0], np.cumsum([len(x) // 6 for x in group["hashes"].to_pylist()])))
    upto = np.concatenate(([0], np.cumsum(sent, dtype=np.int64)))
    six = _six(hashes)
    out = {"hashes": [], "ranks": [], "sent": [], "owners": []}
    for a, b in zip(edges, edges[1:]):
        k = keep[a:b]
        out["hashes"].append(six[a:b][k].tobytes())
        out["ranks"].append(ranks[a:b][k].tobytes())
        out["sent"].append(sent[a:b][k].tobytes())
        out["owners"].append(owners[upto[a] : upto[b]][keep_owner[upto[a] : upto[b]]].tobytes())
    give_back()
    return pa.table({"chunk": group["chunk"]} | {k: pa.array(x, pa.binary()) for k, x in out.items()} | {k: group[k] for k in names(HEAD)})


def _post(num: int, den: int):
    """The blocks of a chunk -> of each of its sets the first shingles in the order of all: by count, then by hash."""

    def run(group: pa.Table) -> pa.Table:
        ids, n, one, two = (_numbers(group[c], np.int64) for c in ("doc_ids", "sizes", "ones", "twos"))
        hashes, ranks = _from_six(group["hashes"]), _numbers(group["ranks"], np.uint8)
        sent, owners = _numbers(group["sent"], np.uint8), _numbers(group["owners"], np.uint16)
        often, often_held, often_owners = _from_six(group["often"]), _numbers(group["often_held"], np.uint32), _numbers(group["often_owners"], np.uint16)
        late = np.flatnonzero(sent == 0)
        late = late[np.argsort(hashes[late])]  # in the order of `often`, which are these shingles
        h = np.concatenate((np.repeat(hashes, sent), np.repeat(often, often_held)))
        r = np.concatenate((np.repeat(ranks, sent), np.repeat(ranks[late], often_held)))
        o = np.concatenate((owners, often_owners)).astype(np.int64)
        order = np.lexsort((h, r, o))
        h, o = h[order], o[order]
        many = np.bincount(o, minlength=len(n))
        first = np.cumsum(many) - many
        place = np.arange(len(o)) - first[o] + (n - many)[o]  # shingles of no other set come before
        keys = n - -(-num * n // den) + 1
        keep = place < (keys + shared_least(n) - 1)[o]
        n_keys = np.bincount(o[place < keys[o]], minlength=len(n))
        h, o = h[keep], o[keep]
        row = np.flatnonzero(n_keys > 0)
        good = n_keys[o] > 0
        lists = list_array(h[good].view(np.int64), np.concatenate(([0], np.cumsum(np.bincount(o[good], minlength=len(n))[row]))), pa.int64())
        return pa.table(dict(zip(names(POSTED), [ids[row], n[row], one[row], two[row], n_keys[row].astype(np.int32), lists])))

    return run


def _linked(num: int, den: int):
    """Rows a, b, mine, theirs (whole sets, in order) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                good.append(_shares_enough(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def t_occurrence(lists: list[list[int]], needed: int, mu: float = 0.01) -> list[tuple[int, int]]:
    """DivideSkip: (id, count) of the ids that occur in at least `needed` of the sorted lists.

    The longest lists are set aside; the short ones are merged with a heap, skipping ahead past ids that cannot
    reach the bound; what they yield is looked up in the long ones by binary search.
    """
    if needed <= 0 or len(lists) < needed:
        return []
    lists = sorted(lists, key=len)
    aside = min(needed - 1, int(needed / (mu * math.log2(max(len(lists[-1]), 2)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    bound = needed - len(long)
    heap = [(x[0], i, 0) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= bound:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= bound:
            count = len(popped)
            for k, x in enumerate(long):
                if count + len(long) - k < needed:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= needed:
                found.append((top, count))
            for _, i, at in popped:
                if at + 1 < len(short[i]):
                    heapq.heappush(heap, (short[i][at + 1], i, at + 1))
        else:  # the next id that can still reach the bound is the smallest left after bound - 1 lists
            while heap and len(popped) < bound - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            ahead = heap[0][0]
            for _, i, at in popped:
                at = bisect_left(short[i], ahead, at)
                if at < len(short[i]):
                    heapq.heappush(heap, (short[i][at], i, at))
    return found


def _shares_enough(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _spanning_links(ids: list[int], listed: np.ndarray, asking: np.ndarray, comp: np.ndarray, posted: list[np.ndarray], bits: list[bytes], items: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Links between asking sets and listed sets that join what no link before joined."""
    asks, there = np.flatnonzero(asking), np.flatnonzero(listed)
    if not len(asks) or not len(there):
        return []
    lengths = np.array([len(p) for p in posted])
    owner = np.repeat(there, lengths[there])
    values = np.concatenate([posted[i] for i in there])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order].tolist()
    names, root = np.unique(comp, return_inverse=True)
    root, apart = root.tolist(), len(names)
    up = list(range(apart))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    for d in asks.tolist():
        if apart == 1:
            break
        low, high = np.searchsorted(values, posted[d], side="left").tolist(), np.searchsorted(values, posted[d], side="right").tolist()
        # a list that holds the query alone can't link it with another set
        lists = [owner[x:y] for x, y in zip(low, high) if y - x > (1 if listed[d] else 0)]
        mine, my_bits = np.frombuffer(items[d], np.uint64), np.frombuffer(bits[d], np.uint8)
        for other, _ in t_occurrence(lists, shared_least(len(mine) * num // den)):
            a, b = top(root[d]), top(root[other])
            if a == b or not _may_link(my_bits, np.frombuffer(bits[other], np.uint8), len(mine), len(items[other]) // 8, num, den):
                continue
            if _shares_enough(mine, np.frombuffer(items[other], np.uint64), num, den):
                up[a] = b
                apart -= 1
                out.append((ids[d], ids[other]))
    return out


def _search(num: int, den: int):
    """Rows sorted by group: leader, band, part, block, id, listed, asking, comp, posted, bits, items; a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            cuts = _group_cuts(now)
            rest = now.slice(cuts[-2])
            yield _compared(now.slice(0, cuts[-2]), cuts[:-1], num, den)
            give_back()
        if rest is not None and rest.num_rows:
            yield _compared(rest, [0, rest.num_rows], num, den)

    return run


def _group_cuts(rows: pa.Table) -> list[int]:
    keys = [rows[c].to_numpy() for c in ("leader", "band", "part", "block")]
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return [0, *np.flatnonzero(new).tolist(), rows.num_rows]


def _compared(rows: pa.Table, cuts: list[int], num: int, den: int) -> pa.RecordBatch:
    out = []
    if rows.num_rows:
        ids, bits, items = (rows[c].to_pylist() for c in ("id", "bits", "items"))
        listed, asking, comp = (rows[c].to_numpy() for c in ("listed", "asking", "comp"))
        lists = rows["posted"].combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        at = at - at[0]
        posted = [values[x:y] for x, y in zip(at, at[1:])]
        for a, b in zip(cuts, cuts[1:]):
            out += _spanning_links(ids[a:b], listed[a:b], asking[a:b], comp[a:b], posted[a:b], bits[a:b], items[a:b], num, den)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def similar_groups(docs: DataFrame, *options, **named) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (its set's size) and component_id; see grouped_rows() for the rest."""
    return grouped_rows(docs, *options, **named).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, group: int = GROUP, part: int = PART) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (its set's size), s1 and s2 (which name its set with it) and component_id.

    Documents link when den * intersection >= num * union of their sets of n-word shingles of ASCII-lower-cased
    words; component_id is the smallest doc_id reachable by links. docs needs doc_id (rows without one take no part)
    and text; other columns are ignored. A null, empty or blank text has an empty set, links with nothing and is its
    own component; a text of fewer than n words is one shingle; equal sets are linked. Rows that repeat a doc_id are
    each given; an empty table gives an empty result.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    scan = stored(src.mapInArrow(_scan(n), SCAN), "ngram-scan")
    classes = scan.where("n_shingles > 0").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"))
    # a class has a number of its own, as the smallest doc_id may name several; a written row's number stays
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "ngram-classes")
    posted = _posted(src, scan, classes, n, num, den)
    lists = _lists(posted, num, den)
    met = classes.join(lists.select("id").distinct(), "id", "left_semi")
    sets = prune_by_ids(src, met.select("doc_id"), "doc_id").mapInArrow(_sets(n), SETS).join(met, ["doc_id", *KEY]).dropDuplicates(["id"])
    sets = stored(sets.select("id", "items", "bits"), "ngram-sets")
    links = _leader_links(sets, lists, num, den, group)
    comp = stored(components(links), "ngram-components")
    found = _searched_links(sets, posted, lists, comp, num, den, part)
    drop_stored(comp, sets, lists, posted)
    comp = stored(classes.join(components(links.union(found)), "id"), "ngram-components")
    least = comp.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.join(comp.join(least, "component").select("id", "component_id"), "id", "left")
    of_class = stored(of_class.select(*KEY, F.coalesce("component_id", "doc_id").alias("component_id")), "ngram-named")
    drop_stored(links, found, comp, classes)
    return scan.join(of_class, KEY, "left").select("doc_id", *KEY, F.coalesce("component_id", "doc_id").alias("component_id"))


def _posted(src: DataFrame, scan: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, n_shingles, n_keys, posted): the first shingles of each class that shares one of its keys with another."""
    total, count = classes.agg(F.sum("n_shingles"), F.count("*")).first()
    buckets = max(1, -(-int(total or 0) // BUCKET_SHINGLES))
    # Rows beside the classes' own ones are to stay out, or copies would count: a row stays if it is not in a bitmap of
    # these, or is in a second one of the classes' own rows that the first one takes for others. Where bitmaps are too
    # small for the data, more copies come along, which changes the order and the work, not the result.
    bits = bitmap_size(count)
    slot = lambda s: F.col("doc_id").bitwiseXOR(F.col(s)).bitwiseAND(F.lit(bits - 1)).alias("slot")
    others = scan.where("n_shingles > 0").join(classes, ["doc_id", *KEY], "left_anti")
    context = src.sparkSession.sparkContext
    first = context.broadcast(slot_bitmap(others.select(slot("s1")), bits))
    unsure = classes.select(slot("s2"), slot("s1").alias("look")).mapInArrow(_hit(first), "slot long")
    second = context.broadcast(slot_bitmap(unsure, bits))
    blocks = src.mapInArrow(_deal(n, buckets, first, second), BLOCK)
    counted = stored(blocks.groupBy("bucket").applyInArrow(_count, COUNTED), "ngram-counted")
    posted = counted.groupBy("chunk").applyInArrow(_post(num, den), POSTED)
    out = stored(posted.join(classes, ["doc_id", *KEY]).select("id", "n_shingles", "n_keys", "posted").dropDuplicates(["id"]), "ngram-posted")
    drop_stored(counted)
    return out


def _hit(bits):
    """Rows slot, look -> the slots of the rows whose look is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0]).filter(pa.array(in_bitmap(bits.value, batch.column(1).to_numpy())))

    return run


def _lists(posted: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, band, id, n_shingles, n, leader, m): the inverted lists of keys with two sets or more of near sizes."""
    posts = posted.select("id", "n_shingles", F.explode(F.slice("posted", F.lit(1), F.col("n_keys"))).alias("shingle"))
    # sizes of linked sets differ by a factor of den / num at most: they lie in one band or in neighbouring ones
    own = F.floor(F.log(F.col("n_shingles")) / math.log(den / num) - 1e-9).cast("int")
    posts = stored(posts.select("shingle", "id", "n_shingles", own.alias("own"), F.explode(F.array(own, own + 1)).alias("band")), "ngram-posts")
    led = posts.groupBy("shingle", "band").agg(F.count("*").alias("n"), F.min(F.struct("id", "n_shingles")).alias("l"), F.max("own").alias("top"))
    # sets that are all of the band below meet there
    led = led.where("n > 1 and top = band").select("shingle", "band", "n", F.col("l.id").alias("leader"), F.col("l.n_shingles").alias("m"))
    out = stored(posts.drop("own").join(led, ["shingle", "band"]), "ngram-lists")
    drop_stored(posts)
    return out


def _with_set(pairs: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """Joins the sets of one end of pairs; an end of many pairs has its set copied to as many parts as they need."""
    parts = pairs.groupBy(end).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    copies = sets.select(F.col("id").alias(end), F.col("items").alias(name)).join(parts, end).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    other = "b" if end == "a" else "a"
    return pairs.join(parts.where("parts > 1"), end, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts").join(copies, [end, "part"]).drop("part")


def _leader_links(sets: DataFrame, lists: DataFrame, num: int, den: int, group: int) -> DataFrame:
    """Links (a, b) between posters of large lists and the leader of near size that most of their lists have."""
    near = lists.where(f"n > {group} and id <> leader and {num} * greatest(m, n_shingles) <= {den} * least(m, n_shingles)").groupBy("id", "leader").agg(F.count("*").alias("votes"))
    chosen = near.groupBy("id").agg(F.max(F.struct("votes", (-F.col("leader")).alias("l"))).alias("v")).select(F.col("id").alias("a"), (-F.col("v.l")).alias("b"))
    pairs = stored(chosen, "ngram-pairs")
    both = _with_set(_with_set(pairs, sets, "b", "theirs"), sets, "a", "mine").select("a", "b", "mine", "theirs")
    out = stored(both.mapInArrow(_linked(num, den), "a long, b long"), "ngram-links")
    drop_stored(pairs)
    return out


def _searched_links(sets: DataFrame, posted: DataFrame, lists: DataFrame, comp: DataFrame, num: int, den: int, group: int) -> DataFrame:
    """Links among posters of a list that are not connected yet, by T-occurrence search.

    Lists of one leader, which near copies have in common, are searched as one group, so a set is there once for each
    leader of its lists, not for each list.
    """
    rows = stored(lists.join(comp, "id", "left").select("shingle", "band", "leader", "id", F.coalesce("component", "id").alias("comp")), "ngram-rooted")  # read twice
    open_ = rows.groupBy("shingle", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("shingle", "band")
    live = stored(rows.join(open_, ["shingle", "band"], "left_semi").select("leader", "band", "id", "comp").distinct(), "ngram-live")
    drop_stored(rows)
    size = live.groupBy("leader", "band").agg(F.count("*").alias("n"), F.min_by("comp", "id").alias("base"))
    asks = live.join(size, ["leader", "band"]).where("comp <> base").groupBy("leader", "band").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    size = stored(size.join(asks, ["leader", "band"]).withColumn("parts", F.ceil(F.col("n") / group).cast("int")), "ngram-sizes")
    own = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    live = live.join(size, ["leader", "band"]).withColumn("part", own("parts", 1)).withColumn("block", F.when(F.col("comp") != F.col("base"), own("blocks", 2)))
    # a set is listed in its part, for every block that asks there, and asks from its block in every part
    cell = lambda part, block, listed, asking: F.struct(part.alias("part"), block.alias("block"), listed.alias("listed"), asking.alias("asking"))
    listed = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(F.col("part"), b, F.lit(True), F.coalesce(b == F.col("block"), F.lit(False))))
    asking = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")), lambda p: cell(p, F.col("block"), F.lit(False), F.lit(True)))
    cells = F.explode(F.when(F.col("block").isNull(), listed).otherwise(F.concat(listed, asking))).alias("cell")
    live = live.select("leader", "band", "id", "comp", cells).select("leader", "band", "cell.*", "id", "comp")
    live = live.join(posted.select("id", "posted").join(sets, "id"), "id").select("leader", "band", "part", "block", "id", "listed", "asking", "comp", "posted", "bits", "items")
    key = ["leader", "band", "part", "block"]
    return stored(live.repartition(*key).sortWithinPartitions(*key).mapInArrow(_search(num, den), "a long, b long"), "ngram-links")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): the one with the smallest doc_id.

    Of rows with the same doc_id one stays: of those that are not near copies of a smaller doc_id the one with the
    smallest text, of equal texts the one with the smallest other columns. Rows without a doc_id, which no link can
    name, stay. Null, empty and blank texts are near copies of nothing and stay; an empty table gives an empty one;
    other columns pass unchanged.
    """
    rows = stored(grouped_rows(docs), "ngram-rows")
    kept = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("n")).where("n > 0")
    kept = stored(kept, "ngram-kept")
    once = docs.join(kept.where("rows = 1"), "doc_id", "left_semi").select(*docs.columns)
    again = kept.where("rows > 1").select("doc_id")
    several = prune_by_ids(docs, again, "doc_id").join(again, "doc_id", "left_semi")
    # texts of repeated ids are cut into sets once more, which tells which of them stays
    texts = several.select("doc_id", F.col("text").cast("string").alias("text")).distinct().mapInArrow(_scan_texts(5), f"{SCAN}, text string")
    stays = texts.join(rows.where("doc_id = component_id").select("doc_id", *KEY).distinct(), ["doc_id", *KEY])
    stays = stays.groupBy("doc_id").agg(F.min("text").alias("__text"), F.count_if(F.col("text").isNull()).alias("__nulls"))
    several = several.join(stays, "doc_id").where("(__nulls > 0 and text is null) or (__nulls = 0 and text = __text)").select(*docs.columns)
    first = several.groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("r")).select("r.*")
    return once.union(first.select(*docs.columns)).union(docs.where("doc_id is null"))
