"""Word-processor packages: parts of zipped packages, and the visible paragraphs of their main text.

Packages are read by Spark's binaryFile source and taken apart in tasks, one package at a time.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The namespaces of the two forms of the format, and the relationship types of the main part.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
STRICT = "{http://purl.oclc.org/ooxml/wordprocessingml/main}"
MAIN_TYPES = ["http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument", "http://purl.oclc.org/ooxml/officeDocument/relationships/officeDocument"]
RELATIONSHIP = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
STORIES = ["header", "footer", "footnotes", "endnotes", "comments"]  # the last words of their relationship types
BROKEN = "!broken"  # the part name of a file that is no package
TYPES = "/[Content_Types].xml"

PARTS = "path string, part_name string, bytes binary"
PARAGRAPHS = "path string, part_name string, para_no int, text string, accepted string, rejected string, mark_deleted boolean, mark_inserted boolean"
GONE, COME = {"del", "moveFrom"}, {"ins", "moveTo"}


def _member(package: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return package.read(name)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError):  # corrupt, encrypted or of an unknown method
        return None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                package = zipfile.ZipFile(io.BytesIO(content))
                names = [n for n in package.namelist() if not n.endswith("/")]
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([BROKEN]), pa.array([None], pa.binary())], names=["path", "part_name", "bytes"])
                continue
            for name in names:  # one after the other: a package may be large
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array(["/" + name.lstrip("/")]), pa.array([_member(package, name)], pa.binary())], names=["path", "part_name", "bytes"])


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, part_name, bytes) of every part of the packages below path.

    A file that is no package gives one row, BROKEN; a part that can't be read has null bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInArrow(_parts, PARTS)


def _content_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                rows = list(ElementTree.fromstring(content or b""))
            except ElementTree.ParseError:
                out.append((path, None, None, None))
                continue
            for r in rows:
                extension, name = r.get("Extension"), r.get("PartName")
                out.append((path, extension and extension.lower(), name and "/" + name.lstrip("/"), r.get("ContentType")))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "extension", "part_name", "content_type"])


def part_types(parts: DataFrame) -> DataFrame:
    """(path, part_name, content_type): what the package's list of content types says of each part, by name or else by extension."""
    from pyspark.sql import functions as F

    listed = parts.where(F.col("part_name") == TYPES).select("path", "bytes").mapInArrow(_content_types, "path string, extension string, part_name string, content_type string")
    own = listed.where("part_name is not null").dropDuplicates(["path", "part_name"]).select("path", "part_name", F.col("content_type").alias("own"))
    usual = listed.where("extension is not null").dropDuplicates(["path", "extension"]).select("path", "extension", F.col("content_type").alias("usual"))
    rows = parts.where(F.col("part_name") != TYPES).select("path", "part_name", F.lower(F.regexp_extract("part_name", r"\.([^./]*)$", 1)).alias("extension"))
    return rows.join(own, ["path", "part_name"], "left").join(usual, ["path", "extension"], "left").select("path", "part_name", F.coalesce("own", "usual").alias("content_type"))


def _read(p: ElementTree.Element) -> tuple[str, str, str]:
    """Text of a paragraph: with all revisions in place, accepted, and rejected."""
    every, accepted, rejected = [], [], []

    def walk(e: ElementTree.Element, gone: bool, come: bool) -> None:
        name = e.tag.removeprefix(WORD)
        gone, come = gone or name in GONE, come or name in COME
        piece = e.text or "" if name in ("t", "delText") else {"tab": "\t", "br": "\n", "cr": "\n"}.get(name, "") if name != "pPr" else ""
        if piece:
            every.append(piece)
            if not gone:
                accepted.append(piece)
            if not come:
                rejected.append(piece)
        if name not in ("pPr", "txbxContent"):  # a text box's paragraphs are paragraphs of their own
            for child in e:
                walk(child, gone, come)

    for child in p:
        walk(child, False, False)
    return "".join(every), "".join(accepted), "".join(rejected)


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, part, content in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                root = ElementTree.fromstring(content or b"")
            except ElementTree.ParseError:
                out.append((path, part, -1, None, None, None, None, None))
                continue
            for e in root.iter():
                if e.tag.startswith(STRICT):
                    e.tag = WORD + e.tag.removeprefix(STRICT)
            for k, p in enumerate(root.iter(f"{WORD}p")):
                mark = p.find(f"{WORD}pPr/{WORD}rPr")
                has = lambda name: mark is not None and mark.find(WORD + name) is not None  # noqa: B023, E731
                out.append((path, part, k, *_read(p), has("del"), has("ins")))
        cols = list(zip(*out)) or [[]] * 8
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "part_name", "para_no", "text", "accepted", "rejected", "mark_deleted", "mark_inserted"])


def _relationships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, name, content in zip(*(c.to_pylist() for c in batch.columns)):
            folder, _, file = name.rpartition("/_rels/")
            source = f"{folder}/{file.removesuffix('.rels')}" if file != ".rels" else "/"
            try:
                rows = list(ElementTree.fromstring(content or b"").iter(RELATIONSHIP))
            except ElementTree.ParseError:
                out.append((path, source, None, None, None, BROKEN))
                continue
            out += [(path, source, r.get("Id"), r.get("Type"), r.get("Target"), r.get("TargetMode", "Internal")) for r in rows]
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "source_part", "rid", "rel_type", "target", "target_mode"])


def read_relationships(parts: DataFrame) -> DataFrame:
    """(path, source_part, rid, rel_type, target, target_mode, target_part) of parts' relationship files; '/' is the package.

    A file that can't be read gives one row of the mode BROKEN.
    """
    from pyspark.sql import functions as F

    from palimpsest.operators.packages import resolved_target

    rows = parts.where(F.endswith("part_name", F.lit(".rels"))).mapInArrow(_relationships, "path string, source_part string, rid string, rel_type string, target string, target_mode string")
    inside = F.concat(F.lit("/"), resolved_target(F.col("source_part"), F.col("target")))
    return rows.withColumn("target_part", F.when(F.col("target_mode") == "Internal", inside))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, modified) of the packages below path, without reading them."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_paragraphs(spark: SparkSession, path: str, stories: bool = False) -> DataFrame:
    """Paragraphs of the main text: as stored, with revisions accepted, with revisions rejected, and their marks' state.

    The main part is the one that the package's relationships name; a part that is no XML gives one row, numbered -1.
    stories: headers, footers, notes and comments of the main part as well.
    """
    from pyspark.sql import functions as F

    parts = read_parts(spark, path)
    related = read_relationships(parts)
    main = related.where((F.col("source_part") == "/") & F.col("rel_type").isin(MAIN_TYPES)).select("path", F.col("target_part").alias("part_name"))
    usual = parts.select("path").distinct().join(main, "path", "left_anti").select("path", F.lit("/word/document.xml").alias("part_name"))
    wanted = main.union(usual)
    if stories:
        kind = F.element_at(F.split("rel_type", "/"), -1)
        beside = related.join(wanted.withColumnRenamed("part_name", "source_part"), ["path", "source_part"], "left_semi").where(kind.isin(STORIES))
        wanted = wanted.union(beside.select("path", F.col("target_part").alias("part_name")))
    return parts.join(wanted, ["path", "part_name"], "left_semi").select("path", "part_name", "bytes").mapInArrow(_paragraphs, PARAGRAPHS)


def resolved_text(paragraphs: DataFrame, accept: bool) -> DataFrame:
    """(path, part_name, para_no, text): a paragraph whose mark goes joins those up to the next that keeps its mark."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    gone, text = ("mark_deleted", "accepted") if accept else ("mark_inserted", "rejected")
    w = Window.partitionBy("path", "part_name").orderBy("para_no")
    begins = F.when(F.lag(gone).over(w), 0).otherwise(1)
    grouped = paragraphs.withColumn("b", begins).withColumn("g", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct("para_no", F.col(text).alias("t"))))
    return grouped.groupBy("path", "part_name", F.col("g").cast("int").alias("para_no")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))
