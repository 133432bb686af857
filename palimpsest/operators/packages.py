"""Parts, relationships, comments and names of packages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The note types that only separate notes from the text.
STRUCTURAL_NOTES = ["separator", "continuationSeparator", "continuationNotice"]


def resolved_target(source_part: Column, target: Column) -> Column:
    """A relationship's target as a part name: from the root, or beside its source; '.' and '..' are followed."""
    folder = F.regexp_replace(source_part, "[^/]*$", "")
    path = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    names = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", up(done)).otherwise(F.array_append(done, s)))
    return F.array_join(names, "/")


def is_external(target: Column) -> Column:
    """Whether a target names a place outside the package: it begins with a scheme."""
    return F.regexp_like(target, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))


def relationship_rows(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, rid, target, external): the targets of all href attributes of a row's markup, numbered from 1."""
    found = F.posexplode(F.regexp_extract_all(markup, F.lit('href="([^"]*)"'), 1)).alias("rid", "target")
    return pages.select(key, found).select(key, (F.col("rid") + 1).alias("rid"), "target", is_external(F.col("target")).alias("external"))


def content_types(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """Adds content_type to parts (part_name): that of the part's own override, else that of its extension."""
    own = overrides.select("part_name", F.col("content_type").alias("__own"))
    usual = defaults.select(F.lower("extension").alias("__extension"), F.col("content_type").alias("__usual"))
    named = parts.withColumn("__extension", F.lower(F.regexp_extract("part_name", r"\.([^./]*)$", 1)))
    return named.join(own, "part_name", "left").join(usual, "__extension", "left").withColumn("content_type", F.coalesce("__own", "__usual")).drop("__own", "__usual", "__extension")


def unique_names(df: DataFrame, name: str, order: list[str], out: str) -> DataFrame:
    """Names made unique by ' (n)' behind the second and later rows of one."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), (n - 1).cast("string"), F.lit(")"))))


def unique_part_names(df: DataFrame, name: str, digest: str, order: str, out: str) -> DataFrame:
    """Names for parts: equal contents share a name, other contents of a taken name get a number."""
    first = df.groupBy(name, digest).agg(F.min(order).alias("__first"))
    n = F.row_number().over(Window.partitionBy(name).orderBy("__first")) - 1
    named = first.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), n.cast("string")))).drop("__first")
    return df.join(named, [name, digest])


# Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 2166136261, 16777619


def group_id_of(name: Column) -> Column:
    """The FNV-1a hash of a name's UTF-8 bytes, without its sign: which move a range belongs to."""
    bits = F.hex(F.encode(name, "utf-8"))
    octets = F.transform(F.sequence(F.lit(1), F.length(bits), F.lit(2)), lambda k: F.conv(F.substring(bits, k, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * FNV_FACTOR).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.when(F.length(name) > 0, octets).otherwise(F.array().cast("array<long>")), F.lit(FNV_START).cast("long"), step).bitwiseAND(F.lit(0x7FFFFFFF))


def fingerprint(*parts: Column) -> Column:
    """The identity of a definition: a digest of its fields in order; a null differs from an empty one."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))


def uncovered(a: DataFrame, b: DataFrame, key: list[str], identity: str) -> DataFrame:
    """(key, n, missing, covered): whether b has each of a's identities as often as a (multiset containment)."""
    count = lambda df, name: df.groupBy(*key, identity).agg(F.count("*").alias(name))
    both = count(a, "na").join(count(b, "nb"), [*key, identity], "left")
    missing = F.sum(F.greatest(F.col("na") - F.coalesce("nb", F.lit(0)), F.lit(0)))
    return both.groupBy(*key).agg(F.sum("na").alias("n"), missing.alias("missing"), (missing == 0).alias("covered"))


def property_signature(properties: Column) -> Column:
    """Names and values of a map in one order; null values do not count."""
    held = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: v.isNotNull())))
    return F.array_join(F.transform(held, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def notes_in_range(notes: DataFrame, partition: list[str], order: list[str], base: int, out: str) -> DataFrame:
    """Numbers notes in document order from base on; structural ones keep out."""
    real = notes.where(~F.col("kind").isin(STRUCTURAL_NOTES))
    return real.withColumn(out, F.lit(base) + F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def insertions_first(rows: DataFrame, partition: list[str], order: list[str], kind: str, same: list[str]) -> DataFrame:
    """Adds place: rows numbered from 1, with a deletion right before an insertion of the same author and date behind it."""
    w = Window.partitionBy(*partition).orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(w))
    match = lambda f: F.forall(F.array(*[F.coalesce(f(c).over(w).eqNullSafe(F.col(c)), F.lit(False)) for c in same]), lambda x: x)
    moves_on = (F.col(kind) == "Deleted") & F.coalesce(F.lead(kind).over(w) == "Inserted", F.lit(False)) & match(F.lead)
    moves_up = (F.col(kind) == "Inserted") & F.coalesce(F.lag(kind).over(w) == "Deleted", F.lit(False)) & match(F.lag)
    return numbered.withColumn("place", F.col("place") + F.when(moves_on, 1).when(moves_up, -1).otherwise(0))
