"""Ordered alignment of text pairs: lines first, then the words inside lines that differ.

The order of steps decides the result, so a pair is aligned by one small recursion inside a task; Spark deals the
pairs to tasks. A text is a list of paragraphs (its visible lines); a paragraph is its words and an end mark.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import SEPARATORS
from palimpsest.operators.align import beside
from palimpsest.operators.sequences import heaviest_run, subsequence
from palimpsest.sources.scratch import dealt, written

MARK = "\n"
THRESHOLD = 0.15
LONG, PIECE = 2000, 500  # lines of both sides of a pair that is dealt in pieces, and about those of a piece
# How many lines both windows need, and from how many characters on a run of one line, of up to three, splits them.
LEAST_UNITS, MANY_UNITS, ATOMS_OF_ONE, ATOMS_OF_FEW = 3, 3, 16, 32
SCHEMA = "a_id long, b_id long, seq_no int, status string, text string"


@lru_cache(maxsize=1)
def _unit_pattern() -> re.Pattern:
    digit = "".join(chr(c) for c in range(0x110000) if chr(c).isdigit())
    alone = re.escape(SEPARATORS) + ".,\u4e00-\u9fff"
    # first what needs no look at digits: spaces, and runs beside no full stop or comma
    return re.compile(f" |[^{alone}]++(?![.,])|(?:[^{alone}]++|[.,](?:(?<=[{digit}].)|(?=[{digit}])))+|.", re.DOTALL)


def words(line: str) -> list[str]:
    """Separators and CJK characters alone, a full stop or comma beside a digit inside its word, else runs; spans of text."""
    return _unit_pattern().findall(line)


def paragraphs(text: str) -> list[str]:
    return [s for s in (text or "").split("\n") if s.strip(" ")]


@lru_cache(maxsize=1 << 16)
def _content(unit: str) -> int:
    if unit.isascii() and unit.isalnum():
        return len(unit)
    return 0 if unit == MARK else sum(c not in SEPARATORS and not c.isspace() for c in unit)


class Units:
    """Both sides of a pair as numbers, with what its units weigh.

    Lines weigh their characters and one for their mark. Words weigh their content first and count second.
    """

    def __init__(self, a: list[str], b: list[str], size=None):
        number: dict[str, int] = {}
        self.a, self.b = ([number.setdefault(x, len(number)) for x in side] for side in (a, b))
        self.units, self.size, self.mark = list(number), size, number.get(MARK, -1)

    @cached_property
    def atoms(self) -> list[int]:
        size = [(len(x) if self.size is None else self.size[x]) + 1 for x in self.units]
        return [0, *accumulate(size[x] for x in self.a)]

    @cached_property
    def rich(self) -> list[int]:
        weight = [(_content(x) << 32) + 1 for x in self.units]
        return [0, *accumulate(weight[x] for x in self.a)]

    def only_separators(self, run: list[int]) -> bool:
        return all(x in SEPARATORS or x == MARK or ("一" <= x <= "鿿" and len(x) == 1) for x in (self.units[k] for k in run))

    def longest(self, i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int]:
        return heaviest_run(self.a, self.b, range(len(self.a) + 1), i0, i1, j0, j1)[:3]

    def richest(self, i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int]:
        i, j, n, weight = heaviest_run(self.a, self.b, self.rich, i0, i1, j0, j1)
        return (i, j, n) if weight >> 32 else (0, 0, 0)

    def correlated(self, i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int]:
        """The run of most characters of two windows of LEAST_UNITS lines or more, if it is large enough; else (0, 0, 0)."""
        if min(i1 - i0, j1 - j0) < LEAST_UNITS:
            return 0, 0, 0
        i, j, n, atoms = heaviest_run(self.a, self.b, self.atoms, i0, i1, j0, j1)
        return (i, j, n) if large_enough(n, atoms) else (0, 0, 0)


def large_enough(n: int, atoms: int) -> bool:
    return n > MANY_UNITS or (n > 1 and atoms > ATOMS_OF_FEW) or (n == 1 and atoms > ATOMS_OF_ONE)


def longest_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of equal ones the first in a, then in b."""
    return Units(a, b).longest(0, len(a), 0, len(b))


def richest_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the common run of most content, then most units; of equal ones the first."""
    return Units(a, b).richest(0, len(a), 0, len(b))


def _ends(u: Units, i0: int, i1: int, j0: int, j1: int, threshold: float) -> tuple[int, int]:
    """Lengths of the common beginning and, without one, of the common end; 0 below the threshold."""
    a, b, least = u.a, u.b, min(i1 - i0, j1 - j0)
    p = 0
    while p < least and a[i0 + p] == b[j0 + p]:
        p += 1
    if p and p / least >= threshold:
        return p, 0
    s = 0
    while s < least and a[i1 - 1 - s] == b[j1 - 1 - s]:
        s += 1
    while s > 1 and a[i1 - s] == u.mark:
        s -= 1
    if s == 1 and a[i1 - 1] == u.mark:
        s = 0
    return (0, s) if s and s / least >= threshold else (0, 0)


def spans(u: Units, block: bool, threshold: float = THRESHOLD) -> list[tuple[str, int, int, int, int]]:
    """(status, start and end in a, start and end in b) in order: Equal, Deleted, Inserted or, for blocks, Unknown.

    Blocks (lines) are first split at their correlated runs. What these leave, and words, are split at common ends, and
    else at the longest run of lines or the run of words with most content.
    """
    out: list[tuple[str, int, int, int, int]] = []
    work = [("", 0, len(u.a), 0, len(u.b))]
    while work:
        status, i0, i1, j0, j1 = work.pop()
        if status:
            out.append((status, i0, i1, j0, j1))
            continue
        if i0 == i1 or j0 == j1:
            out += [("Deleted", i0, i1, j0, j0)] * (i0 < i1) + [("Inserted", i1, i1, j0, j1)] * (j0 < j1)
            continue
        i, j, n = u.correlated(i0, i1, j0, j1) if block else (0, 0, 0)
        if not n:
            p, s = _ends(u, i0, i1, j0, j1, threshold)
            if p:
                i, j, n = i0, j0, p
            elif s:
                i, j, n = i1 - s, j1 - s, s
            else:
                i, j, n = u.longest(i0, i1, j0, j1) if block else u.richest(i0, i1, j0, j1)
                while n > 1 and u.a[i] == u.mark:
                    i, j, n = i + 1, j + 1, n - 1
                run = u.a[i : i + n]
                few = not block and (n <= 3 and u.only_separators(run) or run == [u.mark] or n / max(i1 - i0, j1 - j0) < threshold)
                if not n or few:
                    out += [("Unknown", i0, i1, j0, j1)] if block else [("Deleted", i0, i1, j0, j0), ("Inserted", i1, i1, j0, j1)]
                    continue
        work += [("", i + n, i1, j + n, j1), ("Equal", i, i + n, j, j + n), ("", i0, i, j0, j)]
    return out


def align(a: list[str], b: list[str], block: bool, threshold: float = THRESHOLD, size=None) -> list[tuple[str, list[str], list[str]]]:
    """(status, units of a, units of b) in order; size: what the lines weigh, if not their characters."""
    return [(status, a[i0:i1], b[j0:j1]) for status, i0, i1, j0, j1 in spans(Units(a, b, size), block, threshold)]


def aligned(a_text: str, b_text: str, detail: bool) -> list[tuple[str, str]]:
    """(status, text) of a pair in order, neighbours of one status merged; detail: words inside changed paragraphs."""
    return aligned_lines(paragraphs(a_text), paragraphs(b_text), detail)


def aligned_lines(a: list[str], b: list[str], detail: bool) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []

    def put(status: str, text: str) -> None:
        if out and out[-1][0] == status:
            out[-1] = (status, out[-1][1] + text)
        elif text:
            out.append((status, text))

    full = lambda x: "".join(s + MARK for s in x)
    for status, x, y in align(a, b, True):
        if status == "Unknown" and detail:
            unit = lambda side: [w for s in side for w in [*words(s), MARK]]
            for inner, p, q in align(unit(x), unit(y), False):
                put(inner, "".join(q if inner == "Inserted" else p))
        elif status == "Unknown":
            put("Deleted", full(x))
            put("Inserted", full(y))
        else:
            put(status, full(y if status == "Inserted" else x))
    return out


def _pair_diff(detail: bool):
    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for a_id, b_id, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (status, text) in enumerate(aligned(a, b, detail)):
                    for c, v in zip(cols, (a_id, b_id, k, status, text)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["a_id", "b_id", "seq_no", "status", "text"])

    return run


def piece_diff(detail: bool):
    """Rows a_id, b_id, i0, j0, matched, la, lb (lines of a piece) -> its stretches, numbered by k."""

    def run(batches):
        for batch in batches:
            out = []
            for a_id, b_id, i0, j0, matched, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                done = [("Equal", "".join(s + MARK for s in a))] if matched else aligned_lines(a or [], b or [], detail)
                out += [(a_id, b_id, i0, j0, k, *x) for k, x in enumerate(done)]
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["a_id", "b_id", "i0", "j0", "k", "status", "text"])

    return run


def diff(pairs: DataFrame, docs: DataFrame, detail: bool = True, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(a_id, b_id, seq_no, status, text): Equal, Deleted and Inserted stretches; joined, either side's text comes back.

    A pair is aligned by one task, unless both sides have over `long` lines in all: then it is split at its correlated
    runs into windows of about `piece` lines, which tasks align one by one. The result is the same.
    """
    from palimpsest.operators import windows
    from palimpsest.sources.tables import hashed_lines

    pairs, large = by_size(pairs, docs, long)
    whole = beside(pairs, docs, "text").mapInArrow(_pair_diff(detail), SCHEMA)
    if large is None:
        return whole
    return whole.union(windows.diff_in_pieces(large, hashed_lines(docs), detail, piece))


def by_size(pairs: DataFrame, docs: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame | None]:
    """The pairs whose sides have up to `long` lines in all, and the others, None if there are none; both are written."""
    n = docs.select("doc_id", F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")), F.lit(0)).alias("n"))
    pairs = written(pairs.select("a_id", "b_id"), "diff-pairs")
    some = n.where(F.col("n") * 2 > long).select("doc_id")  # one side at least is half as long
    if not some.take(1):
        return pairs, None
    either = pairs.join(some, F.col("a_id") == F.col("doc_id"), "left_semi").union(pairs.join(some, F.col("b_id") == F.col("doc_id"), "left_semi")).distinct()
    large = either.join(n.select(F.col("doc_id").alias("a_id"), F.col("n").alias("na")), "a_id").join(n.select(F.col("doc_id").alias("b_id"), F.col("n").alias("nb")), "b_id").where(F.col("na") + F.col("nb") > long)
    large = written(large.select("a_id", "b_id"), "diff-long")
    if not large.take(1):
        return pairs, None
    return pairs.join(large, ["a_id", "b_id"], "left_anti"), large


def revisions(diffs: DataFrame, author: str = "Redline", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Numbered revisions: what is not equal, with author and date."""
    from palimpsest.operators.islands import renumber

    rows = renumber(diffs.where("status <> 'Equal'"), ["a_id", "b_id"], ["seq_no"], "rev_no")
    return rows.select("a_id", "b_id", "rev_no", F.col("status").alias("type"), "text", F.lit(author).alias("author"), F.lit(date).alias("date"))


def revision_json(revs: DataFrame) -> DataFrame:
    """Each revision as a JSON object of eight fields; those that do not apply are null."""
    fields = ["type", "author", "date", F.lit("document").alias("part"), F.col("move_group_id").alias("moveGroupId"), F.col("is_move_source").alias("isMoveSource"), F.lit(None).cast("string").alias("formatChange"), "text"]
    return revs.select("a_id", "b_id", "rev_no", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def revisions_to_json(revs: DataFrame) -> DataFrame:
    """(a_id, b_id, json): all revisions of a pair as one JSON array."""
    rows = F.array_sort(F.collect_list(F.struct("rev_no", "json")))
    return revision_json(revs).groupBy("a_id", "b_id").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["json"]), ","), F.lit("]")).alias("json"))


def resolve(diffs: DataFrame, accept: bool) -> DataFrame:
    """(a_id, b_id, text): accepting drops deletions, rejecting drops insertions."""
    drop = "Deleted" if accept else "Inserted"
    kept = F.when(F.col("status") != drop, F.col("text")).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("seq_no", kept.alias("t"))))
    return diffs.groupBy("a_id", "b_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def _row_lcs(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Longest common subsequence; going back, an insertion is taken before a deletion when both are as good."""
    met = subsequence(a, b, gone_first=False)
    out, i, j = [], 0, 0
    for p, q in [*met, (len(a), len(b))]:
        out += [("Deleted", k, None) for k in range(i, p)] + [("Inserted", None, k) for k in range(j, q)]
        if p < len(a) or q < len(b):
            out.append(("Equal", p, q))
        i, j = p + 1, q + 1
    return out


def _rows(batches):
    for batch in batches:
        out = []
        for a_id, b_id, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(a_id, b_id, k, *x) for k, x in enumerate(_row_lcs(a, b))]
        cols = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["a_id", "b_id", "seq_no", "status", "i", "j"])


def row_lcs(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a_id, b_id, seq_no, status, i, j) for the table-like lines (with ' | ') of each pair."""
    rows = hashed.where(F.contains("line", F.lit(" | "))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "h"))).alias("r"))
    rows = rows.select("doc_id", F.transform("r", lambda x: x["h"]).alias("r"))
    both = pairs.select("a_id", "b_id").join(rows.select(F.col("doc_id").alias("a_id"), F.col("r").alias("ra")), "a_id").join(rows.select(F.col("doc_id").alias("b_id"), F.col("r").alias("rb")), "b_id")
    return dealt(both.select("a_id", "b_id", "ra", "rb"), "a_id", "b_id").mapInArrow(_rows, "a_id long, b_id long, seq_no int, status string, i int, j int")
