"""Elements of tagged text: their tree, digests from the bottom up, ranges between marks, and what lies inside ranges."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Elements that hold nothing.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>"
ELEMENTS = "element_no int, parent_no int, depth int, name string, path string, n_inside int, digest string"


def elements_of(html: str) -> list[tuple[int, int | None, int, str, str, int, str]]:
    """(number, parent's number, depth, name, path, elements inside, digest) of every element, in order of their starts.

    A path has the names from the root on, each with its place among its parent's elements of that name. A digest is
    that of the name and of what is inside, in order: digests of elements, and text with runs of white space as one
    space. An end tag closes the nearest open element of its name and all within it, or nothing; at the end all close.
    """
    out: list[list] = []
    stack = [[-1, "", [], {}]]  # number, path, parts of the digest, how many children of each name

    def close() -> None:
        number, _, parts, _ = stack.pop()
        digest = hashlib.sha1("".join([out[number][3], *parts]).encode()).hexdigest()
        out[number][5], out[number][6] = len(out) - number - 1, digest
        stack[-1][2].append("<" + digest)

    at = 0
    for m in re.finditer(TAG, html):
        words = " ".join(html[at : m.start()].split())
        if words:
            stack[-1][2].append(">" + words)
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if any(name == out[e[0]][3] for e in stack[1:]):
                while out[stack[-1][0]][3] != name:
                    close()
                close()
            continue
        seen = stack[-1][3]
        seen[name] = seen.get(name, 0) + 1
        parent = stack[-1][0]
        path = f"{stack[-1][1]}/{name}:{seen[name]}"
        out.append([len(out), parent if parent >= 0 else None, len(stack) - 1, name, path, 0, ""])
        stack.append([len(out) - 1, path, [], {}])
        if name in VOID or m[0].endswith("/>"):
            close()
    words = " ".join(html[at:].split())
    if words:
        stack[-1][2].append(">" + words)
    while len(stack) > 1:
        close()
    return [tuple(x) for x in out]


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and ELEMENTS: every element of each row's tagged text, with the digest of all it holds; null has none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, found = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                mine = elements_of(text or "")
                found += mine
                row += [r] * len(mine)
            columns = list(zip(*found)) or [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, *(x.split()[0] for x in ELEMENTS.split(", "))])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, {ELEMENTS}")


def shared_subtrees(found: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(digest, holders, copies, first): digests of elements with `least` elements inside or more that several rows hold.

    Only the largest count: elements whose parent is shared as well are part of its copies.
    """
    held = found.where(F.col("n_inside") >= least).groupBy("digest").agg(F.count_distinct(key).alias("holders"), F.count("*").alias("copies"), F.min(key).alias("first")).where("holders > 1")
    parents = found.join(held.select("digest"), "digest", "left_semi").select(key, F.col("element_no").alias("parent_no"))
    largest = found.join(held.select("digest"), "digest", "left_semi").join(parents, [key, "parent_no"], "left_anti").select("digest").distinct()
    return held.join(largest, "digest", "left_semi")


def tag_stream(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, name, closes, offset): the tags in order, and how many characters of text are before each."""
    part = r"<!--[\s\S]*?-->|</?[a-zA-Z][^>]*>|<|[^<]+"
    parts = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(part), F.lit(0))).alias("seq", "part"))
    tag = F.regexp_extract("part", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)
    is_tag = tag != ""
    silent = is_tag | F.startswith("part", F.lit("<!--"))
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.when(silent, 0).otherwise(F.length("part"))).over(before), F.lit(0))
    rows = parts.select(key, "seq", F.lower(tag).alias("name"), F.startswith("part", F.lit("</")).alias("closes"), offset.alias("offset"), is_tag.alias("is_tag"))
    return rows.where("is_tag").drop("is_tag")


def ranges_of(events: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, id, start, end): each closing event and the first opening one of its id, where that is before it."""
    first = events.where("not closes").groupBy(key, id_).agg(F.min(F.struct("seq", "offset")).alias("s"))
    ends = events.where("closes").join(first, [key, id_]).where(F.col("seq") > F.col("s.seq"))
    return ends.select(key, id_, "seq", F.col("s.offset").alias("start"), F.col("offset").alias("end"))


def matched_elements(events: DataFrame, key: str) -> DataFrame:
    """(key, name, opened, closed): start and end of every element by the running depth of its name; what has no end is left out."""
    order = Window.partitionBy(key, "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("closes"), -1).otherwise(1)).over(order)
    rows = events.withColumn("level", depth + F.col("closes").cast("int"))
    after = Window.partitionBy(key, "name", "level").orderBy("seq")
    rows = rows.withColumn("closed", F.lead("seq").over(after)).withColumn("ends", F.lead("closes").over(after))
    return rows.where("not closes and ends").select(key, "name", F.col("seq").alias("opened"), "closed")


def inside_ranges(found: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """Adds `inside`: whether both ends of an element are within ranges, by the running number of ranges open there.

    marks: key, seq, closes: opening and closing marks of ranges that are known to have both.
    """
    ends = found.select(key, F.col("opened").alias("seq")).union(found.select(key, F.col("closed").alias("seq"))).distinct().withColumn("step", F.lit(None).cast("int"))
    both = ends.union(marks.select(key, "seq", F.when(F.col("closes"), -1).otherwise(1).alias("step")))
    # of marks and ends in one place the marks do not hold the ends in: a range holds what is strictly within it
    order = Window.partitionBy(key).orderBy("seq", F.when(F.col("step") == 1, 2).when(F.col("step") == -1, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    open_ = both.withColumn("open", F.sum(F.coalesce("step", F.lit(0))).over(order)).where("step is null").select(key, "seq", (F.col("open") > 0).alias("held"))
    at = lambda c, name: open_.select(key, F.col("seq").alias(c), F.col("held").alias(name))
    return found.join(at("opened", "__o"), [key, "opened"]).join(at("closed", "__c"), [key, "closed"]).withColumn("inside", F.col("__o") & F.col("__c")).drop("__o", "__c")
