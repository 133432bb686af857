"""Registered queries over packages, notes, comments, formats, ladders and subscriptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import align, packages, relations, state, stats
from palimpsest.plans.queries import HASHED, LINES, PAIRS, SIDES, docs_of, letters, pairs_of, query
from palimpsest.sources.tables import hashed_lines, lines, neighbour_pairs, table

# --- packages

TARGETS = "case o_orderpriority when '1-URGENT' then '../media/i1.png' when '2-HIGH' then '/docProps/app.xml' when '3-MEDIUM' then './x/../y.xml' when '5-LOW' then 'styles.xml' else '../../custom/z.xml' end"


@query(
    f"with t as (select o_orderkey, 'word/d' || (o_custkey % 5) || '/p' || o_orderkey || '.xml' as source_part, {TARGETS} as target from orders)"
    ", s as (select o_orderkey, list_filter(string_split(case when starts_with(target, '/') then target else regexp_replace(source_part, '[^/]*$', '') || target end, '/'), lambda x: x <> '' and x <> '.') as steps from t)"
    " select o_orderkey, array_to_string(list_reduce(list_prepend(cast([] as varchar[]), list_transform(steps, lambda x: [x])), lambda done, x: case when x[1] = '..' then done[1:len(done) - 1] else list_concat(done, x) end), '/') as part from s"
)
def rel_target_resolve(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("word/d"), F.col("o_custkey") % 5, F.lit("/p"), F.col("o_orderkey"), F.lit(".xml")).alias("source_part"), F.expr(TARGETS).alias("target"))
    return o.select("o_orderkey", packages.resolved_target(F.col("source_part"), F.col("target")).alias("part"))


@query("with r as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) as rid from pages) select page_id, cast(rid as int) as rid, target, regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') as external from r")
def page_relationships(spark, sf_dir):
    return packages.relationship_rows(table(spark, sf_dir, "pages"), "page_id", "html")


PART_NAMES = "replace(p_name, ' ', '_') || '.' || lower(string_split(p_type, ' ')[-1])"


@query(
    f"with p as (select p_partkey, {PART_NAMES} as part_name, lower(string_split(p_type, ' ')[-1]) as ext, p_size, p_brand from part), o as (select part_name, max(p_brand) as t from p where p_size > 45 group by 1), d as (select ext, min(p_brand) as t from p where p_size < 5 group by 1)"
    " select p_partkey, part_name, coalesce(o.t, d.t) as content_type from p left join o using (part_name) left join d using (ext)"
)
def content_type_lookup(spark, sf_dir):
    extension = F.lower(F.element_at(F.split("p_type", " "), -1))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), extension).alias("part_name"), extension.alias("extension"), "p_size", "p_brand")
    own = p.where("p_size > 45").groupBy("part_name").agg(F.max("p_brand").alias("content_type"))
    usual = p.where("p_size < 5").groupBy("extension").agg(F.min("p_brand").alias("content_type"))
    return packages.content_types(p.select("p_partkey", "part_name"), own, usual)


@query("with n as (select p_partkey, p_type, row_number() over (partition by p_type order by p_partkey) as k from part) select p_partkey, case when k = 1 then p_type else p_type || ' (' || (k - 1) || ')' end as name from n")
def unique_output_names(spark, sf_dir):
    return packages.unique_names(table(spark, sf_dir, "part"), "p_type", ["p_partkey"], "name").select("p_partkey", "name")


@query(
    "with f as (select p_type, p_brand, min(p_partkey) as first from part group by 1, 2), n as (select *, row_number() over (partition by p_type order by first) - 1 as k from f)"
    " select p_partkey, case when k = 0 then p_type else p_type || k end as name from part join n using (p_type, p_brand)"
)
def unique_part_names(spark, sf_dir):
    return packages.unique_part_names(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), "p_type", "p_brand", "p_partkey", "name").select("p_partkey", "name")


@query("select c_nationkey, max(c_custkey) + 1 as next_id, max(c_custkey) - count(*) as gaps from customer group by 1")
def next_free_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.max("c_custkey") + 1).alias("next_id"), (F.max("c_custkey") - F.count("*")).alias("gaps"))


@query("select s_suppkey, list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(generate_series(1, octet_length(encode(s_name))), lambda k: cast('0x' || substr(hex(encode(s_name)), 2 * k - 1, 2) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) & 2147483647 as move_group_id from supplier")
def move_group_ids(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", packages.group_id_of(F.col("s_name")).alias("move_group_id"))


@query("select p_partkey, lower(hex(encode(p_name))) as hex, length(p_name) as n, true as round_trip from part")
def hex_codec(spark, sf_dir):
    h = F.lower(F.hex(F.encode("p_name", "UTF-8")))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("hex"), F.length("p_name").cast("long").alias("n"), (F.decode(F.unhex(h), "UTF-8") == F.col("p_name")).alias("round_trip"))


@query("select page_id, sha1(array_to_string(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1), '>')) as structure, sha1(html) as content from pages")
def structure_digests(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit("<(/?[a-zA-Z][a-zA-Z0-9]*)"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(F.array_join(tags, ">")).alias("structure"), F.sha1("html").alias("content"))


@query("select page_id, trim(coalesce(nullif(trim(regexp_extract(html, '<meta name=\"author\" content=\"([^\"]*)\"', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''))) as author from pages")
def page_authors(spark, sf_dir):
    part = lambda pattern: F.when(F.trim(F.regexp_extract("html", pattern, 1)) != "", F.trim(F.regexp_extract("html", pattern, 1)))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(part('<meta name="author" content="([^"]*)"'), part("<title>([^<]*)</title>")).alias("author"))


@query("select p_type, p_brand, count(*) as styles, count(distinct 'brand=' || p_brand || ';size=' || p_size) as signatures, max('brand=' || p_brand || ';size=' || p_size) as last_signature from part group by 1, 2")
def style_signatures(spark, sf_dir):
    props = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("none"), F.lit(None).cast("string"))
    p = table(spark, sf_dir, "part").withColumn("s", packages.property_signature(props))
    return p.groupBy("p_type", "p_brand").agg(F.count("*").alias("styles"), F.count_distinct("s").alias("signatures"), F.max("s").alias("last_signature"))


# --- notes and comments

IDENTITY = "sha1(role || chr(31) || text || chr(31) || coalesce(right(before, 20), chr(0)))"
TURNS = "w as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations)"


@query(f"with {TURNS} select conv_id, turn, sha1(role || chr(31) || turn || chr(31) || text) as definition, {IDENTITY} as anchored from w")
def comment_identities(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("before", F.right(before, F.lit(20)))
    return c.select("conv_id", "turn", packages.fingerprint(F.col("role"), F.col("turn"), F.col("text")).alias("definition"), packages.fingerprint(F.col("role"), F.col("text"), F.col("before")).alias("anchored"))


@query(
    "with c as (select conv_id, sha1(role || chr(31) || text) as h, count(*) as n from conversations group by 1, 2)"
    " select a.conv_id, cast(sum(a.n) as bigint) as n, cast(sum(greatest(a.n - coalesce(b.n, 0), 0)) as bigint) as missing, sum(greatest(a.n - coalesce(b.n, 0), 0)) = 0 as covered from c a left join c b on b.conv_id = a.conv_id + 1 and b.h = a.h group by 1"
)
def comments_covered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", packages.fingerprint(F.col("role"), F.col("text")).alias("h"))
    return packages.uncovered(c, c.withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "h")


@query("select conv_id, turn, cast(1000 + row_number() over (partition by conv_id order by turn) - 1 as int) as note_id from conversations where role <> 'system' and text <> ''")
def notes_unique_range(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").where("text <> ''").withColumn("kind", F.when(F.col("role") == "system", "separator").otherwise("normal"))
    return packages.notes_in_range(notes, ["conv_id"], ["turn"], 1000, "note_id").select("conv_id", "turn", "note_id")


@query(
    "with e as (select user_id, event_id, case when event_id % 3 = 0 then 'Inserted' when event_id % 3 = 1 then 'Deleted' else 'Equal' end as kind, event_type, row_number() over w as k from events window w as (partition by user_id order by ts, event_id))"
    ", m as (select *, lead(kind) over w as next_kind, lag(kind) over w as last_kind, lead(event_type) over w as next_type, lag(event_type) over w as last_type from e window w as (partition by user_id order by k))"
    " select event_id, cast(k + case when kind = 'Deleted' and next_kind = 'Inserted' and next_type = event_type then 1 when kind = 'Inserted' and last_kind = 'Deleted' and last_type = event_type then -1 else 0 end as int) as place from m"
)
def insertions_before_deletions(spark, sf_dir):
    third = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(third == 0, "Inserted").when(third == 1, "Deleted").otherwise("Equal"))
    return packages.insertions_first(e, ["user_id"], ["ts", "event_id"], "kind", ["event_type"]).select("event_id", "place")


@query("select l_orderkey, count(*) as atoms, min(l_linestatus) = max(l_linestatus) as fully_revised, case when min(l_linestatus) = max(l_linestatus) then min(l_linestatus) end as status from lineitem group by 1")
def fully_revised_rows(spark, sf_dir):
    one = F.min("l_linestatus") == F.max("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("atoms"), one.alias("fully_revised"), F.when(one, F.min("l_linestatus")).alias("status"))


# --- formats


@query(
    "with e as (select event_id, event_type, json_extract_string(props, '$.k') as new, lag(event_type) over w as last_type, lag(json_extract_string(props, '$.k')) over w as old from events window w as (partition by user_id order by ts, event_id))"
    " select event_id, coalesce(old, '') as old_value, coalesce(new, '') as new_value, 'fontSize' as changed from e where last_type = event_type and old is distinct from new"
)
def format_changes(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("p", F.map_filter(F.create_map(F.lit("sz"), F.get_json_object("props", "$.k")), lambda k, v: v.isNotNull()))
    e = e.withColumn("old", F.lag("p").over(w)).withColumn("last_type", F.lag("event_type").over(w)).where("last_type = event_type")
    names = relations.map_difference(F.col("old"), F.col("p"))
    value = lambda m: F.coalesce(F.try_element_at(F.col(m), F.lit("sz")), F.lit(""))
    return e.where(F.size(names) > 0).select("event_id", value("old").alias("old_value"), value("p").alias("new_value"), F.array_join(F.transform(names, T.friendly_name), ",").alias("changed"))


# --- paragraphs and pairs


@query(
    "with l as (select doc_id, cast(p - 1 as int) as k, s[p] as line from (select doc_id, string_split(text, chr(10)) as s from documents), lateral (select unnest(generate_series(1, len(s))) as p))"
    ", g as (select *, sum(case when trim(line) = '' then 1 else 0 end) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding) as run from l)"
    " select doc_id, cast(coalesce(run, 0) as bigint) as run, min(k) as first_line, count(*) as n_lines, cast(sum(length(trim(line))) as bigint) as real_chars, coalesce(min(k) filter (trim(line) = ''), max(k) + 1) as next_mark from g group by 1, 2"
)
def paragraph_runs(spark, sf_dir):
    l = docs_of(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    blank = F.trim("line") == ""
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    l = l.withColumn("run", F.coalesce(F.sum(blank.cast("long")).over(before), F.lit(0)))
    return l.groupBy("doc_id", "run").agg(F.min("k").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length(F.trim("line"))).alias("real_chars"), F.coalesce(F.min(F.when(blank, F.col("k"))), F.max("k") + 1).alias("next_mark"))


PAIR_TOKENS = "t as (select doc_id, " + letters("coalesce(text, '')") + " as t from documents)"


@query(
    f"with {PAIRS}, {PAIR_TOKENS}, p as (select a_id, b_id, x.t as ta, y.t as tb, list_filter(x.t, lambda s: length(s) >= 4) as la, list_filter(y.t, lambda s: length(s) >= 4) as lb from pairs join t x on x.doc_id = a_id join t y on y.doc_id = b_id)"
    ", q as (select *, list_transform(generate_series(1, least(len(la), len(lb))), lambda k: la[k] = lb[k]) as same from p)"
    " select a_id, b_id, cast(len(list_intersect(list_intersect(ta, tb), ['and', 'the', 'for'])) as int) as connectors, cast(len(list_intersect(list_filter(ta, lambda s: length(s) >= 3 and s <> 'doc' and s <> 'docx'), tb)) as int) as body_shared,"
    " cast(coalesce(list_position(same, false) - 1, len(same)) as int) as ordered_prefix from q"
)
def pair_token_signals(spark, sf_dir):
    pairs, _ = pairs_of(spark, sf_dir)
    sets = docs_of(spark, sf_dir).select("doc_id", T.letter_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    p = pairs.select("a_id", "b_id").join(sets.select(F.col("doc_id").alias("a_id"), F.col("t").alias("ta")), "a_id").join(sets.select(F.col("doc_id").alias("b_id"), F.col("t").alias("tb")), "b_id")
    return p.select("a_id", "b_id", T.shared_connectors(F.col("ta"), F.col("tb")).alias("connectors"), F.size(F.array_intersect(T.body_tokens(F.col("ta")), F.col("tb"))).alias("body_shared"), T.ordered_prefix(F.col("ta"), F.col("tb")).alias("ordered_prefix"))


@query(
    f"with {SIDES}, d as (select a_id, b_id, i, {letters('line_a')} as ta, {letters('line_b')} as tb from a join b using (a_id, b_id) where i = j)"
    ", s as (select a_id, b_id, i, case when len(list_distinct(ta)) + len(list_distinct(tb)) = 0 then 1.0 else len(list_intersect(ta, tb)) / (len(list_distinct(ta)) + len(list_distinct(tb)) - len(list_intersect(ta, tb))) end as s from d)"
    ", n as (select doc_id, count(*) as n from h group by 1)"
    " select a_id, b_id, round(min(s), 6) as least, round(avg(s), 6) as mean, round(coalesce(max(s) filter (i > 0), 0), 6) as most_of_body from s join n x on x.doc_id = a_id join n y on y.doc_id = b_id where x.n = y.n group by 1, 2"
)
def pair_diagonal_stats(spark, sf_dir):
    return align.diagonal_stats(*pairs_of(spark, sf_dir))


@query(
    f"with {HASHED}, pairs as (select * from (select doc_id as a_id, lead(doc_id) over (partition by source, lang order by doc_id) as b_id from documents) where b_id is not null)"
    f", s as (select doc_id, count(*) as n, list_distinct(flatten(list(list_filter({letters('line')}, lambda t: length(t) >= 4)) filter (line_no > 0))) as t from lines group by 1)"
    " select a_id, b_id, x.n >= 2 and y.n >= 2 and len(list_intersect(x.t, y.t)) = 0 as residual_unrelated from pairs join s x on x.doc_id = a_id join s y on y.doc_id = b_id"
)
def pair_residual_unrelated(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return align.residual_unrelated(neighbour_pairs(docs), lines(docs))


# --- tools


@query(
    f"with {SIDES}, o as (select coalesce(a.a_id, b.a_id) as a_id, coalesce(a.b_id, b.b_id) as b_id, coalesce(i, j) as p, ha, hb from a full join b on a.a_id = b.a_id and a.b_id = b.b_id and i = j)"
    " select a_id, b_id, min(p) filter (ha is distinct from hb) as first_difference, cast(count(ha) as bigint) as ours, cast(count(hb) as bigint) as theirs from o group by 1, 2"
)
def opseq_first_difference(spark, sf_dir):
    return align.first_difference(*pairs_of(spark, sf_dir))


@query(
    f"with {HASHED}, pairs as (select * from (select doc_id as a_id, lead(doc_id) over (partition by source, lang order by doc_id) as b_id from documents) where b_id is not null)"
    ", s as (select doc_id, sha1(string_agg(h, '' order by line_no)) as ordered, sha1(string_agg(h, '' order by h)) as held, count(*) as n, list_distinct(list(h)) as hs from h group by 1)"
    " select case when x.ordered = y.ordered then 'same' when x.held = y.held then 'L1-opseq' when x.n = y.n then 'L2-inventory' when list_has_any(x.hs, y.hs) then 'L3-histogram' else 'apart' end as level, count(*) as n from pairs join s x on x.doc_id = a_id join s y on y.doc_id = b_id group by 1"
)
def parity_ladder(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return align.ladder(neighbour_pairs(docs), hashed_lines(docs)).groupBy("level").agg(F.count("*").alias("n"))


@query(
    f"with {HASHED}, f as (select doc_id, 'duplicate_line' as finding from h group by doc_id, h having count(*) > 1 union all select doc_id, 'duplicate_id' from documents group by doc_id having count(*) > 1"
    " union all select doc_id, 'no_visible_text' from documents where trim(coalesce(text, '')) = '' union all select doc_id, 'wrong_length' from documents where n_chars <> length(text) union all select doc_id, 'replacement_sign' from documents where contains(text, chr(65533)))"
    " select finding, count(*) as n, count(distinct doc_id) as documents from f group by 1"
)
def defect_signatures(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    found = stats.findings(
        docs, "doc_id",
        {
            "no_visible_text": F.trim(F.coalesce("text", F.lit(""))) == "",
            "wrong_length": F.col("n_chars") != F.length("text"),
            "replacement_sign": F.contains("text", F.lit("�")),
        },
    )
    twice = lambda df, key, name: df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(name).alias("finding"))
    found = found.union(twice(hashed_lines(docs), ["doc_id", "h"], "duplicate_line")).union(twice(docs, ["doc_id"], "duplicate_id"))
    return found.groupBy("finding").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


TRIALS = (
    "with t as (select o_custkey, case when o_orderstatus = 'F' then 'A' else 'B' end as side, o_totalprice as v from orders), m as (select o_custkey, side, count(*) as n, median(v) as md from t group by 1, 2)"
    ", s as (select o_custkey, side, n, md, median(abs(v - md)) as mad from t join m using (o_custkey, side) group by 1, 2, 3, 4), a as (select * from s where side = 'A'), b as (select * from s where side = 'B')"
    ", v as (select case when a.n is null or b.n is null then 'insufficient' when b.md - a.md > greatest(0.05 * a.md, 1.5 * a.mad) then 'regress' when b.md - a.md < -greatest(0.05 * a.md, 1.5 * a.mad) then 'improve' else 'noise' end as verdict from a full join b on a.o_custkey = b.o_custkey)"
)


@query(TRIALS + " select count(*) as fixtures, count(*) filter (verdict = 'regress') as regress, count(*) filter (verdict = 'improve') as improve, case when bool_or(verdict = 'regress') then 'regress' when bool_or(verdict = 'improve') then 'improve_or_mixed' else 'noise' end as overall from v")
def trial_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("side"), F.col("o_totalprice").alias("v"))
    return stats.summarize(stats.verdicts(o, "o_custkey", "side", "v"))


@query(
    "with a as (select l_suppkey, avg(l_quantity) as s from lineitem where l_returnflag = 'A' group by 1), b as (select l_suppkey, avg(l_quantity) as s from lineitem where l_returnflag = 'R' group by 1)"
    " select count(*) as pairs, round(avg(b.s) - avg(a.s), 6) as mean_delta, round(median(b.s) - median(a.s), 6) as median_delta, round(quantile_cont(b.s, 0.1) - quantile_cont(a.s, 0.1), 6) as p10_delta from a join b using (l_suppkey)"
)
def ledger_deltas(spark, sf_dir):
    of = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.avg("l_quantity").alias("s"))
    return stats.ledger_deltas(of("A"), of("R"), "l_suppkey", "s")


# --- state


@query("select c_custkey, cast(least(coalesce(count(event_id), 0), 5) as int) as used from customer left join events on user_id = c_custkey group by 1")
def quota_peek(spark, sf_dir):
    return state.peek(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 5)


@query("select user_id, cast(list_reduce(list_prepend(0, list(case when event_type = 'click' then -1 else 1 end order by ts, event_id)), lambda used, d: least(greatest(used + d, 0), 5)) as int) as used from events group by 1")
def quota_release(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("stretch", F.to_date("ts"))
    return state.released(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", 5)


@query(
    "select o_orderkey, case when o_orderstatus = 'F' then 'Production' else 'Sandbox' end as environment, coalesce(case when o_custkey % 3 > 0 then o_custkey end, case when o_orderpriority <> '5-LOW' then o_orderkey end, 0) as signed_date_ms, case when o_orderpriority <> '5-LOW' then o_orderpriority = '1-URGENT' else false end as auto_renew from orders"
)
def subscription_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    renewal = F.when(F.col("o_orderpriority") != "5-LOW", F.struct(F.col("o_orderkey").alias("signed"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("auto_renew")))
    transaction = F.struct(F.when(F.col("o_orderstatus") == "F", "Production").otherwise("Test").alias("environment"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("signed"))
    return o.select("o_orderkey", *state.subscription_state(transaction, renewal))
