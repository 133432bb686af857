"""Unions of keyed sets with ids given anew, properties inherited along chains, and keyed notes of two versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import diff


def union_comments(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """(group, id, parent, text, side, old_id): b's comments, and those of a that b lacks, under ids that are free.

    a and b: group, id, parent (the id of the comment replied to, or null), text. A comment of a with the id and text
    of one of b is that one. One with the id of another is numbered from the largest id of b on, past ids that a's
    other comments keep; replies follow their comments, also to b's copy.
    """
    theirs = b.select(group, "id", F.col("text").alias("b_text"))
    met = a.join(theirs, [group, "id"], "left")
    same = F.col("b_text").isNotNull() & F.col("text").eqNullSafe(F.col("b_text"))
    taken = b.select(group, "id", F.lit(True).alias("taken")).distinct()
    met = met.select(group, "id", "parent", "text", same.alias("same")).join(taken, [group, "id"], "left")
    keeps, moves = met.where("taken is null"), met.where("taken and not same")
    top = b.groupBy(group).agg(F.max("id").alias("top"))
    need = moves.groupBy(group).agg(F.count("*").alias("need"))
    kept = keeps.groupBy(group).agg(F.count("*").alias("n"))
    room = need.join(top, group).join(kept, group, "left").withColumn("most", F.col("need") + F.coalesce("n", F.lit(0)))
    free = room.select(group, F.explode(F.sequence(F.col("top") + 1, F.col("top") + F.col("most"))).alias("new_id"))
    free = free.join(keeps.select(group, F.col("id").alias("new_id")), [group, "new_id"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("new_id")))
    moves = moves.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("id"))).join(free, [group, "k"]).select(group, "id", "parent", "text", "new_id")
    added = keeps.select(group, "id", "parent", "text", F.col("id").alias("new_id")).union(moves)
    names = added.select(group, F.col("id").alias("parent"), F.col("new_id").alias("new_parent"))
    added = added.join(names, [group, "parent"], "left").select(group, F.col("new_id").alias("id"), F.coalesce("new_parent", "parent").alias("parent"), "text", F.lit("a").alias("side"), F.col("id").alias("old_id"))
    return b.select(group, "id", "parent", "text", F.lit("b").alias("side"), F.col("id").alias("old_id")).union(added)


def effective_props(styles: DataFrame, most: int = 11) -> DataFrame:
    """(id, props): each style's properties with those it inherits: the nearest of its chain counts.

    styles: id, based_on, props (map of strings). A style that is based on an unknown one, or on itself in a round,
    inherits up to there; a chain has `most` links at most. A property that a style sets to null counts as set.
    """
    empty = F.create_map().cast("map<string,string>")
    own = styles.select(F.col("id").alias("up"), F.col("based_on").alias("further"), F.coalesce("props", empty).alias("more"))
    now = styles.select("id", F.col("based_on").alias("up"), F.coalesce("props", empty).alias("props"), F.array("id").alias("seen"))
    for _ in range(most):
        now = now.join(own, "up", "left").select(
            "id",
            F.when(F.array_contains("seen", F.col("further")), None).otherwise(F.col("further")).alias("up"),
            F.when(F.col("more").isNull(), F.col("props")).otherwise(F.map_concat("props", F.map_filter("more", lambda k, v: ~F.map_contains_key("props", k)))).alias("props"),
            F.when(F.col("more").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("up"))).alias("seen"),
        )
    return now.select("id", "props")


def revised_styles(a: DataFrame, b: DataFrame, match: str = "id", most: int = 11) -> DataFrame:
    """(match, property, old, new): what changes in the styles of both versions whose own and inherited properties differ.

    A style reaching the same result by inheritance is not changed, nor is one that differs only by an ancestor, which
    is changed itself. old and new are what the styles declare themselves; null where they do not.
    """
    empty = F.create_map().cast("map<string,string>")
    side = lambda s, k: s.select("id", match, F.coalesce("props", empty).alias(f"own_{k}")).join(effective_props(s, most).select("id", F.col("props").alias(f"all_{k}")), "id").drop(*(["id"] if match != "id" else []))
    differ = lambda x, y: F.size(F.map_filter(F.map_zip_with(x, y, lambda k, v, w: ~v.eqNullSafe(w)), lambda k, v: v)) > 0
    both = side(a, "a").join(side(b, "b"), match).where(differ("own_a", "own_b")).where(differ("all_a", "all_b"))
    names = F.explode(F.array_union(F.map_keys("own_a"), F.map_keys("own_b"))).alias("property")
    rows = both.select(match, "own_a", "own_b", names).select(match, "property", F.try_element_at("own_a", F.col("property")).alias("old"), F.try_element_at("own_b", F.col("property")).alias("new"))
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def note_revisions(a: DataFrame, b: DataFrame, key: list[str], part: str = "footnotes") -> DataFrame:
    """(key, rev_no, type, text, part): revisions of keyed notes of two versions, note by note.

    a and b: key, text. A note that only one version has is deleted or inserted as a whole; notes of both are aligned
    as pairs of texts are. Notes have no moves.
    """
    rows = a.withColumnRenamed("text", "ta").join(b.withColumnRenamed("text", "tb"), key, "full_outer").select(*key, "ta", "tb")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(key)]) + ", rev_no int, type string, text string"

    def run(batches):
        for batch in batches:
            row, found = [], []
            for r, (x, y) in enumerate(zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist())):
                changed = [z for z in diff.aligned(x or "", y or "", True) if z[0] != "Equal"]
                found += [(k + 1, *z) for k, z in enumerate(changed)]
                row += [r] * len(changed)
            columns = list(zip(*found)) or [[]] * 3
            ids = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=[*key, "rev_no", "type", "text"])

    return rows.mapInArrow(run, schema).withColumn("part", F.lit(part))
