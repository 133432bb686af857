"""Registered queries over windows, left-over lines, tables, trees of elements, notes, comments and inherited styles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import diff, merging, pairing, table_functions, trees, windows
from palimpsest.plans.queries import SIDES, SIZES, SPACE, docs_of, letters, pairs_of, query
from palimpsest.sources.tables import table, turn_pairs

# --- windows and subsequences


@query(None)
def correlated_windows(spark, sf_dir):
    return windows.correlated_windows(*pairs_of(spark, sf_dir))


@query(None)
def turn_word_matches(spark, sf_dir):
    return pairing.word_matches(turn_pairs(table(spark, sf_dir, "conversations")), ["conv_id", "role", "turn"], "a_text", "b_text")


@query(None)
def turn_word_matches_eligible(spark, sf_dir):
    return pairing.word_matches(turn_pairs(table(spark, sf_dir, "conversations")), ["conv_id", "role", "turn"], "a_text", "b_text", eligible=True)


@query(None)
def turn_diff_units(spark, sf_dir):
    table_functions.register(spark)
    turn_pairs(table(spark, sf_dir, "conversations")).createOrReplaceTempView("turns_compared")
    return spark.sql("select conv_id, role, turn, d.seq_no, d.status, d.text from turns_compared, lateral diff_units(a_text, b_text) d")


# --- pairs of lines

SETS = f"list_distinct({letters('line_a')}) as ta", f"list_distinct({letters('line_b')}) as tb"
JACCARD = "case when len(ta) = 0 and len(tb) = 0 then 1.0 else len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) end"


@query(
    f"with {SIDES}{SIZES}, x as (select a.a_id, a.b_id, i, {SETS[0]} from a join sizes s on s.a_id = a.a_id and s.b_id = a.b_id and s.na = s.nb), y as (select b.a_id, b.b_id, j, {SETS[1]} from b)"
    f", met as (select x.a_id, x.b_id, i, j, {JACCARD} as s from x join y on x.a_id = y.a_id and x.b_id = y.b_id)"
    ", r as (select a_id, b_id, i, max(s) filter (i = j) as d, coalesce(max(s) filter (i <> j), 0) as off from met group by 1, 2, 3)"
    ", g as (select a_id, b_id, count(*) as lines, count(*) filter (d > 0 and d + 1e-9 >= off) as wins, avg(d) as average from r group by 1, 2)"
    " select a_id, b_id, lines, wins, round(average, 6) as average, wins * 2 >= lines and (average >= 0.08 or (lines <= 4 and average >= 0.04)) as dominant from g"
)
def pair_diagonal_dominant(spark, sf_dir):
    return pairing.diagonal_dominant(*pairs_of(spark, sf_dir))


_LONG = "list_filter({}, lambda t: length(t) >= 4)"
_NOTHING = ", ".join(f"'{w}'" for w in pairing.SAYS_NOTHING)
RESIDUAL = (
    f"with {SIDES}, x as (select a.a_id, a.b_id, row_number() over (partition by a.a_id, a.b_id order by i) - 1 as i, line_a as line from a where not exists (select 1 from b where b.a_id = a.a_id and b.b_id = a.b_id and hb = ha))"
    ", y as (select b.a_id, b.b_id, row_number() over (partition by b.a_id, b.b_id order by j) - 1 as j, line_b as line from b where not exists (select 1 from a where b.a_id = a.a_id and b.b_id = a.b_id and hb = ha))"
    f", l as (select *, {letters('line')} as la, list_distinct({letters('line')}) as ta, count(*) over (partition by a_id, b_id) as na from x), r as (select *, {letters('line')} as lb, list_distinct({letters('line')}) as tb, count(*) over (partition by a_id, b_id) as nb from y)"
    f", m as (select l.a_id, l.b_id, i, j, na, nb, la, lb, ta, tb, {_LONG.format('la')} as ga, {_LONG.format('lb')} as gb, len(list_intersect({_LONG.format('ta')}, {_LONG.format('tb')})) as shared, len(ta) <= 8 and len(tb) <= 8 as short, len(ta) <= 16 and len(tb) <= 16 as body from l join r on l.a_id = r.a_id and l.b_id = r.b_id where na <= 6 and len(ta) > 0 and len(tb) > 0)"
    f", f as (select *, coalesce(body and ga[-1] = gb[-1], false) as same_end, short and i = 0 and shared = 0 and len(list_filter(list_intersect(ta, tb), lambda t: t in ('and', 'the', 'for'))) > 0 as connected"
    ", nb <= 20 and len(ga) >= 2 and len(gb) >= 2 and ga[1:2] = gb[1:2] as begins"
    f", i >= 1 and j > i and na <= 4 and nb <= 4 and body and coalesce(ga[-1] not in ({_NOTHING}) and list_contains(lb, ga[-1]), false) as further, {JACCARD} as s from m)"
    ", c as (select a_id, b_id, cast(i as int) as i, cast(j as int) as j, case when same_end then 3 when further then 2 else 1 end as tier, s as similarity from f"
    " where (shared >= (case when same_end or connected or begins or further then 1 when short then 2 else 3 end) or connected or begins)"
    " and s + 1e-12 >= (case when same_end and short then 0.10 when same_end or further then 0.05 when connected or begins then 0.10 else 0.25 end))"
)


@query(RESIDUAL + " select a_id, b_id, i, j, tier, round(similarity, 6) as similarity from c")
def pair_residual_candidates(spark, sf_dir):
    c = pairing.residual_candidates(*pairs_of(spark, sf_dir))
    return c.withColumn("similarity", F.round("similarity", 6))


@query(None)
def pair_residual_pairs(spark, sf_dir):
    return pairing.residual_pairs(*pairs_of(spark, sf_dir))


@query(
    f"with {SIDES}, rows as (select doc_id, row_number() over (partition by doc_id order by line_no) as k, h, sha1(regexp_replace(line, '{SPACE}', '', 'g')) as loose, len(string_split(line, ' | ')) as cells, len(list_filter(string_split(line, ' | '), lambda c: trim(c) = '')) > 0 as e from h where contains(line, ' | '))"
    ", shape as (select doc_id, count(*) as n, bool_or(e) as merged, string_agg(cells, ',' order by k) as shape from rows group by 1)"
    ", p as (select a_id, b_id, x.n as na, y.n as nb, x.merged or y.merged as merged, x.shape = y.shape as same_shape from pairs join shape x on x.doc_id = a_id join shape y on y.doc_id = b_id)"
    ", d as (select a_id, b_id, count(*) filter (x.h <> y.h) as changed, bool_and(x.loose = y.loose) as alike from p join rows x on x.doc_id = a_id join rows y on y.doc_id = b_id and x.k = y.k where na = nb group by 1, 2)"
    " select p.a_id, p.b_id, na, nb, changed, merged, case when alike and changed > 1 and changed < na and changed > na // 3 and na >= 7 then 'content' when alike then 'place' when merged and same_shape then 'place' when merged then 'place and remainder' else 'general' end as route from p left join d using (a_id, b_id)"
)
def table_routes(spark, sf_dir):
    return pairing.table_routes(*pairs_of(spark, sf_dir))


@query(None)
def table_row_statuses(spark, sf_dir):
    return pairing.table_rows(*pairs_of(spark, sf_dir))


# --- trees of elements


@query(None)
def page_elements(spark, sf_dir):
    return trees.elements(table(spark, sf_dir, "pages"), "page_id", "html")


@query(None)
def page_shared_subtrees(spark, sf_dir):
    return trees.shared_subtrees(trees.elements(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


PART = r"<!--[\s\S]*?-->|</?[a-zA-Z][^>]*>|<|[^<]+"
STREAM = (
    f"parts as (select page_id, p - 1 as seq, l[p] as part from (select page_id, regexp_extract_all(html, '{PART}') as l from pages), lateral (select unnest(generate_series(1, len(l))) as p))"
    ", named as (select *, regexp_extract(part, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1) as tag from parts)"
    ", placed as (select *, coalesce(sum(case when tag <> '' or starts_with(part, '<!--') then 0 else length(part) end) over (partition by page_id order by seq rows between unbounded preceding and 1 preceding), 0) as off from named)"
    ", tags as (select page_id, seq, lower(tag) as name, starts_with(part, '</') as closes, cast(off as bigint) as off from placed where tag <> '')"
)


@query(
    f"with {STREAM}, s as (select page_id, name, min(seq) as first, arg_min(off, seq) as start from tags where not closes group by 1, 2)"
    ' select page_id, name, cast(seq as int) as seq, start, off as "end" from tags join s using (page_id, name) where closes and seq > first'
)
def page_ranges(spark, sf_dir):
    return trees.ranges_of(trees.tag_stream(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id", "name")


@query(
    f"with {STREAM}, l as (select *, sum(case when closes then -1 else 1 end) over (partition by page_id, name order by seq) + case when closes then 1 else 0 end as level from tags)"
    ", m as (select *, lead(seq) over w as closed, lead(closes) over w as ends from l window w as (partition by page_id, name, level order by seq))"
    ", e as (select page_id, name, seq as opened, closed from m where not closes and ends), nav as (select * from e where name = 'nav')"
    " select page_id, name, cast(opened as int) as opened, cast(closed as int) as closed, exists (select 1 from nav n where n.page_id = e.page_id and n.opened < e.opened and e.opened < n.closed) and exists (select 1 from nav n where n.page_id = e.page_id and n.opened < e.closed and e.closed < n.closed) as inside from e"
)
def page_elements_in_ranges(spark, sf_dir):
    found = trees.matched_elements(trees.tag_stream(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    nav = found.where("name = 'nav'")
    marks = nav.select("page_id", F.col("opened").alias("seq"), F.lit(False).alias("closes")).union(nav.select("page_id", F.col("closed"), F.lit(True)))
    return trees.inside_ranges(found, "page_id", marks)


# --- notes, comments and styles


def _note_versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Turns of a role, taken in twos: the first of each is a note's old version, the second its new one."""
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1
    notes = table(spark, sf_dir, "conversations").withColumn("k", place).select("conv_id", "role", F.floor(F.col("k") / 2).alias("note"), (F.col("k") % 2).alias("version"), "text")
    return tuple(notes.where(F.col("version") == v).drop("version") for v in (0, 1))


@query(None)
def note_revisions(spark, sf_dir):
    return merging.note_revisions(*_note_versions(spark, sf_dir), ["conv_id", "role", "note"])


@query(
    "with k as (select conv_id, role, (row_number() over (partition by conv_id, role order by turn) - 1) as k, text from conversations), n as (select conv_id, role, k // 2 as note, k % 2 as v, text from k)"
    ", p as (select conv_id, role, note, x.text as ta, y.text as tb from (select * from n where v = 0) x full join (select * from n where v = 1) y using (conv_id, role, note))"
    ", c as (select *, array_to_string(list_transform(list_filter(string_split(coalesce(ta, ''), chr(10)), lambda s: trim(s) <> ''), lambda s: s || chr(10)), '') as ca, array_to_string(list_transform(list_filter(string_split(coalesce(tb, ''), chr(10)), lambda s: trim(s) <> ''), lambda s: s || chr(10)), '') as cb from p)"
    " select conv_id, role, note, cast(length(cb) - length(ca) as bigint) as grown, ca <> cb as changed from c"
)
def note_growth(spark, sf_dir):
    """What the notes' revisions add less what they take, which the lengths of both versions give as well."""
    a, b = _note_versions(spark, sf_dir)
    key = ["conv_id", "role", "note"]
    size = F.when(F.col("type") == "Inserted", F.length("text")).otherwise(-F.length("text"))
    sums = merging.note_revisions(a, b, key).groupBy(*key).agg(F.sum(size).alias("grown"), F.count("*").alias("n"))
    return a.select(*key).union(b.select(*key)).distinct().join(sums, key, "left").select(*key, F.coalesce("grown", F.lit(0)).cast("long").alias("grown"), (F.coalesce("n", F.lit(0)) > 0).alias("changed"))


@query(
    "with c as (select conv_id // 2 as g, conv_id % 2 as side, cast(turn as bigint) as id, case when turn > 0 then cast(turn - 1 as bigint) end as parent, text from conversations), b as (select * from c where side = 0)"
    ", a as (select a.*, b.id is not null as taken, coalesce(b.text = a.text, false) as same from c a left join b on b.g = a.g and b.id = a.id where a.side = 1)"
    ", keeps as (select * from a where not taken), moves as (select *, row_number() over (partition by g order by id) as k from a where taken and not same)"
    ", need as (select g, count(*) as need from moves group by 1), top as (select g, max(id) as top from b group by 1)"
    ", free as (select g, x as new_id, row_number() over (partition by g order by x) as k from (select g, unnest(generate_series(top + 1, top + need + 1000)) as x from need join top using (g)) f where not exists (select 1 from keeps where keeps.g = f.g and keeps.id = f.x))"
    ", added as (select g, id, parent, text, id as new_id from keeps union all select g, m.id, parent, text, new_id from moves m join free using (g, k))"
    " select g, id, parent, text, 'b' as side, id as old_id from b union all select a.g, a.new_id, coalesce(p.new_id, a.parent), a.text, 'a', a.id from added a left join added p on p.g = a.g and p.id = a.parent"
)
def comments_union(spark, sf_dir):
    t = F.col("turn").cast("long")
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 2).alias("g"), (F.col("conv_id") % 2).alias("side"), t.alias("id"), F.when(t > 0, t - 1).alias("parent"), "text")
    return merging.union_comments(c.where("side = 1").drop("side"), c.where("side = 0").drop("side"), "g")


def _styles(spark, sf_dir, revised: bool) -> DataFrame:
    """Regions, nations based on them and customers based on these as styles; the revised version changes some of each."""
    r, n, c = (table(spark, sf_dir, name) for name in ("region", "nation", "customer"))
    props = lambda **p: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, p)), F.array(*p.values())), lambda k, v: v.isNotNull())
    when = lambda condition, value, otherwise=None: F.when(F.expr(condition), value).otherwise(otherwise)
    regions = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("based_on"), props(font=F.col("r_name")).alias("props"))
    color = when("n_nationkey % 5 = 0", F.lit("red"), F.col("n_name")) if revised else F.col("n_name")
    nations = n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), props(color=color, font=when("n_nationkey % 3 = 0", F.col("n_name"))))
    size = when("c_custkey % 6 <> 0", F.col("c_mktsegment")) if revised else F.col("c_mktsegment")
    own = when("c_custkey % 4 = 0", F.col("c_mktsegment"), when("c_custkey % 7 = 0", F.col("n_name")) if revised else None)
    customers = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), props(size=size, color=own))
    return reduce(DataFrame.union, [regions, nations, customers])


STYLES = (
    "with s as (select 'r' || r_regionkey as id, cast(null as varchar) as up, r_name as font, cast(null as varchar) as color, cast(null as varchar) as size, r_name as font2, cast(null as varchar) as color2, cast(null as varchar) as size2 from region"
    " union all select 'n' || n_nationkey, 'r' || n_regionkey, case when n_nationkey % 3 = 0 then n_name end, n_name, null, case when n_nationkey % 3 = 0 then n_name end, case when n_nationkey % 5 = 0 then 'red' else n_name end, null from nation"
    " union all select 'c' || c_custkey, 'n' || c_nationkey, null, case when c_custkey % 4 = 0 then c_mktsegment end, c_mktsegment, null, case when c_custkey % 4 = 0 then c_mktsegment when c_custkey % 7 = 0 then n_name end, case when c_custkey % 6 <> 0 then c_mktsegment end from customer join nation on c_nationkey = n_nationkey)"
    ", e as (select s.*, coalesce(s.font, p.font, q.font) as ef, coalesce(s.color, p.color, q.color) as ec, coalesce(s.size, p.size, q.size) as es, coalesce(s.font2, p.font2, q.font2) as ef2, coalesce(s.color2, p.color2, q.color2) as ec2, coalesce(s.size2, p.size2, q.size2) as es2 from s left join s p on p.id = s.up left join s q on q.id = p.up)"
)


@query(STYLES + " select id, ef as font, ec as color, es as size from e")
def style_effective_props(spark, sf_dir):
    props = merging.effective_props(_styles(spark, sf_dir, False))
    return props.select("id", *[F.try_element_at("props", F.lit(p)).alias(p) for p in ("font", "color", "size")])


@query(
    STYLES + ", d as (select * from e where (font is distinct from font2 or color is distinct from color2 or size is distinct from size2) and (ef is distinct from ef2 or ec is distinct from ec2 or es is distinct from es2))"
    " select * from (select id, 'font' as property, font as old, font2 as new from d union all select id, 'color', color, color2 from d union all select id, 'size', size, size2 from d) where old is distinct from new"
)
def styles_revised(spark, sf_dir):
    return merging.revised_styles(_styles(spark, sf_dir, False), _styles(spark, sf_dir, True))
