"""The registered queries of the revision engine: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import align, diff, islands, relations, similarity, state, stats
from palimpsest.sources.tables import hashed_lines, lines, neighbour_pairs, first_holder_pairs, table, turn_pairs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


# SQL shared by the oracles
SEP, SPACE = T.SEPARATOR_CLASS, T.SPACE_CLASS
LINES = "lines as (select doc_id, cast(p - 1 as int) as line_no, l[p] as line from (select doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') as l from documents), lateral (select unnest(generate_series(1, len(l))) as p))"
HASHED = LINES + ", h as (select doc_id, line_no, line, sha1(line) as h from lines)"
PAIRS = HASHED + (
    ", holders as (select distinct h, doc_id from h), firsts as (select h, min(doc_id) as a_id from holders group by h having count(*) > 1)"
    ", pairs as (select a_id, doc_id as b_id, count(*) as shared from holders join firsts using (h) where doc_id > a_id group by 1, 2)"
)
SIDES = PAIRS + (
    ", a as (select a_id, b_id, line_no as i, h as ha, line as line_a from pairs join h on h.doc_id = a_id)"
    ", b as (select a_id, b_id, line_no as j, h as hb, line as line_b from pairs join h on h.doc_id = b_id)"
)
SIZES = ", n as (select doc_id, count(*) as n from h group by 1), sizes as (select a_id, b_id, x.n as na, y.n as nb, least(x.n, y.n) as shorter from pairs join n x on x.doc_id = a_id join n y on y.doc_id = b_id)"


def tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SEP}'), lambda t: t <> '')"


def letters(c: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({c}, '{T.UPPER}', '{T.LOWER}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def score(c: str) -> str:
    return f"length(regexp_replace(regexp_replace({c}, '{SPACE}', '', 'g'), '{SEP}', '', 'g'))"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pairs_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hashed = hashed_lines(docs_of(spark, sf_dir))
    return first_holder_pairs(hashed), hashed


# --- tokens, canonical forms and digests


@query(f"with {LINES} select * from lines")
def doc_lines(spark, sf_dir):
    return lines(docs_of(spark, sf_dir))


@query(f"with {LINES} select doc_id, line_no, sha1(line) as h, sha1(regexp_replace(line, '{SPACE}', '', 'g')) as h_space, sha1('t' || translate(line, ' ', chr(160))) as h_atom from lines")
def line_hashes(spark, sf_dir):
    c = F.col("line")
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", F.sha1(c).alias("h"), F.sha1(T.strip_space(c)).alias("h_space"), T.atom_hash("t", c).alias("h_atom"))


@query(f"with {LINES} select doc_id, line_no, array_to_string(list_sort(list_distinct({tok('line')})), '|') as tokens, cast(len(list_distinct({tok('line')})) as int) as n from lines")
def word_tokens(spark, sf_dir):
    t = T.token_set(F.col("line"))
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", F.array_join(F.array_sort(t), "|").alias("tokens"), F.size(t).alias("n"))


@query(f"select doc_id, cast(len({tok('text')}) as bigint) as n_words, cast(len(regexp_split_to_array(text, '{SEP}')) as bigint) as n_parts, sha1(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) as collapsed from documents")
def word_counts(spark, sf_dir):
    c = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", T.count_words(c).cast("long").alias("n_words"), F.size(T.separated(c)).cast("long").alias("n_parts"), F.sha1(T.collapse_space(c)).alias("collapsed"))


@query(f"with {LINES} select doc_id, line_no, cast({score('line')} as bigint) as score, sum({score('line')}) over (partition by doc_id order by line_no) as up_to from lines")
def content_score(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", T.content_score(F.col("line")).cast("long").alias("score")).withColumn("up_to", F.sum("score").over(w))


@query(f"with {LINES}, t as (select doc_id, line_no, list_filter({letters('line')}, lambda x: length(x) >= 4) as t from lines) select doc_id, line_no, cast(len(t) as int) as n, t[-1] as last_token from t")
def token_significant(spark, sf_dir):
    t = T.significant(F.col("line"))
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", F.size(t).alias("n"), F.try_element_at(t, F.lit(-1)).alias("last_token"))


@query(f"with {LINES}, c as (select doc_id, line_no, k, sha1('t' || translate(substr(line, k, 1), ' ', chr(160))) as h from lines, lateral (select unnest(generate_series(1, length(line))) as k)) select doc_id, line_no, count(*) as n_atoms, sha1(string_agg(h, '' order by k)) as h_word from c group by 1, 2")
def atom_digests(spark, sf_dir):
    chars = F.split("line", "")
    hashes = F.transform(chars, lambda c: T.atom_hash("t", c))
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", F.size(chars).cast("long").alias("n_atoms"), T.digest_of_digests(hashes).alias("h_word"))


@query("select p_partkey, cast(round(p_size * 20.0) as bigint) as pt, cast(round(p_size * (1440 / 2.54)) as bigint) as cm, cast(round(p_size * (1440 / 25.4)) as bigint) as mm from part")
def measure_twips(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", *[T.twips(n, F.lit(u)).alias(u) for u in ("pt", "cm", "mm")])


@query("select page_id, sha1(replace(replace(replace(replace(html, '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')) as h from pages")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(T.decode_entities(F.col("html"))).alias("h"))


# --- neighbouring groups, offsets, numbers


@query(
    "with m as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as b from events window w as (partition by user_id order by ts, event_id)),"
    " g as (select *, cast(sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) - 1 as bigint) as group_no from m)"
    " select user_id, group_no, min(event_type) as event_type, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from g group by 1, 2"
)
def group_adjacent_events(spark, sf_dir):
    g = islands.group_adjacent(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return g.groupBy("user_id", "group_no").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "with m as (select *, case when lag(role) over w = role then 0 else 1 end as b from conversations window w as (partition by conv_id order by turn)),"
    " g as (select *, cast(sum(b) over (partition by conv_id order by turn rows unbounded preceding) - 1 as bigint) as group_no from m)"
    " select conv_id, group_no, min(role) as role, count(*) as n, sum(length(text)) as chars from g group by 1, 2"
)
def group_adjacent_roles(spark, sf_dir):
    g = islands.group_adjacent(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return g.groupBy("conv_id", "group_no").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"with {LINES} select doc_id, line_no, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as start from lines")
def running_offsets(spark, sf_dir):
    return islands.running_offset(lines(docs_of(spark, sf_dir)), ["doc_id"], ["line_no"], F.length("line") + 1, "start").select("doc_id", "line_no", F.col("start").cast("long").alias("start"))


@query("select s_suppkey, cast(row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as int) as no, cast(dense_rank() over (order by s_nationkey) as int) as nation_no from supplier")
def renumber_dense(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nations = islands.renumber(s.select("s_nationkey").distinct().withColumn("one", F.lit(1)), ["one"], ["s_nationkey"], "nation_no").drop("one")
    s = s.withColumn("neg", -F.col("s_acctbal"))
    return islands.renumber(s, ["s_nationkey"], ["neg", "s_suppkey"], "no").join(nations, "s_nationkey").select("s_suppkey", "no", "nation_no")


ORDER_RANKS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 3}


@query("select o_orderkey, cast(row_number() over (partition by o_custkey order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 else 4 end, o_orderkey) as int) as place from orders")
def rank_table_sort(spark, sf_dir):
    return islands.rank_by_table(table(spark, sf_dir, "orders"), "o_orderpriority", ORDER_RANKS, ["o_custkey"], ["o_orderkey"], "place").select("o_orderkey", "place")


# --- pairs and their alignment


@query(f"with {PAIRS} select * from pairs")
def doc_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir)[0]


PAIR_SETS = ", t as (select doc_id, list_distinct(" + letters("coalesce(text, '')") + ") as t from documents), p as (select a_id, b_id, x.t as ta, y.t as tb, len(list_intersect(x.t, y.t)) as met from pairs join t x on x.doc_id = a_id join t y on y.doc_id = b_id)"


@query(
    f"with {PAIRS}{PAIR_SETS} select a_id, b_id, round(case when len(ta) + len(tb) = 0 then 1.0 else met / (len(ta) + len(tb) - met) end, 6) as jaccard,"
    " round(case when least(len(ta), len(tb)) = 0 then 0.0 else met / least(len(ta), len(tb)) end, 6) as overlap,"
    " least(len(ta), len(tb)) >= 40 and met / greatest(least(len(ta), len(tb)), 1) >= 0.55 as stamped_variant from p"
)
def pair_similarity(spark, sf_dir):
    return similarity.pair_similarity(pairs_of(spark, sf_dir)[0], docs_of(spark, sf_dir))


RELATED = (
    ", ra as (select a_id, b_id, count(*) as na, count(*) filter (exists (select 1 from b where b.a_id = a.a_id and b.b_id = a.b_id and b.hb = a.ha)) as met_a from a group by 1, 2)"
    ", rb as (select a_id, b_id, count(*) as nb, count(*) filter (exists (select 1 from a where b.a_id = a.a_id and b.b_id = a.b_id and b.hb = a.ha)) as met_b from b group by 1, 2)"
)


@query(f"with {SIDES}{RELATED} select a_id, b_id, na, nb, met_a, met_b, case when na <= nb then met_a / na else met_b / nb end >= 0.2 as related from ra join rb using (a_id, b_id)")
def pair_windows_related(spark, sf_dir):
    return align.lines_related(*pairs_of(spark, sf_dir))


@query(
    f"with {HASHED}, pairs as (select * from (select doc_id as a_id, lead(doc_id) over (partition by source, lang order by doc_id) as b_id from documents) where b_id is not null)"
    ", s as (select doc_id, list(distinct h) as hs, count(*) as n from h group by 1)"
    " select a_id, b_id, x.n >= 4 and y.n >= 4 and not list_has_any(x.hs, y.hs) as unrelated from pairs join s x on x.doc_id = a_id join s y on y.doc_id = b_id"
)
def pair_unrelated(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return align.unrelated(neighbour_pairs(docs), hashed_lines(docs))


@query(
    f"with {SIDES}{SIZES}, f as (select a_id, b_id, min(i) as front from a join b using (a_id, b_id) where i = j and ha <> hb group by 1, 2)"
    ", k as (select a_id, b_id, min(na - 1 - i) as back from a join b using (a_id, b_id) join sizes using (a_id, b_id) where na - i = nb - j and ha <> hb group by 1, 2)"
    ", e as (select a_id, b_id, shorter, coalesce(front, shorter) as p, coalesce(back, shorter) as s from sizes left join f using (a_id, b_id) left join k using (a_id, b_id))"
    " select a_id, b_id, case when p / shorter >= 0.15 then p else 0 end as prefix, case when s / shorter >= 0.15 then s else 0 end as suffix, shorter from e"
)
def pair_common_ends(spark, sf_dir):
    return align.common_ends(*pairs_of(spark, sf_dir))


RUNS = (
    f"with {SIDES}, m as (select a_id, b_id, i, j, i - j as d, {score('line_a')} as s from a join b using (a_id, b_id) where ha = hb)"
    ", r as (select *, i - row_number() over (partition by a_id, b_id, d order by i) as g from m)"
    ", runs as (select a_id, b_id, d, g, min(i) as i, min(j) as j, count(*) as n, cast(sum(s) as bigint) as score from r group by 1, 2, 3, 4)"
)


@query(RUNS + " select a_id, b_id, i, j, n, score from runs qualify row_number() over (partition by a_id, b_id order by n desc, i, j) = 1")
def pair_longest_run(spark, sf_dir):
    return align.longest_run(*pairs_of(spark, sf_dir))


@query(RUNS + " select a_id, b_id, i, j, n, score from runs qualify row_number() over (partition by a_id, b_id order by score desc, n desc, i, j) = 1")
def pair_longest_run_scored(spark, sf_dir):
    return align.longest_run(*pairs_of(spark, sf_dir), scored=True)


@query(RUNS + " select a_id, b_id, max(n) >= 3 as has_run from runs group by 1, 2")
def pair_kgram_exists(spark, sf_dir):
    return align.has_common_run(*pairs_of(spark, sf_dir))


@query(
    f"with {SIDES}, x as (select *, row_number() over (partition by a_id, b_id, ha order by i) as k from a), y as (select *, row_number() over (partition by a_id, b_id, hb order by j) as k from b)"
    " select coalesce(x.a_id, y.a_id) as a_id, coalesce(x.b_id, y.b_id) as b_id, case when x.ha is not null and y.hb is not null then 'Equal' when x.ha is not null then 'Deleted' else 'Inserted' end as status, count(*) as n"
    " from x full join y on x.a_id = y.a_id and x.b_id = y.b_id and x.ha = y.hb and x.k = y.k group by 1, 2, 3"
)
def diff_summary(spark, sf_dir):
    return align.diff_by_occurrence(*pairs_of(spark, sf_dir))


@query(
    f"with {SIDES} select coalesce(a.a_id, b.a_id) as a_id, coalesce(a.b_id, b.b_id) as b_id, case when ha is null then 'Inserted' when hb is null then 'Deleted' when ha = hb then 'Equal' else 'Unknown' end as status, count(*) as n"
    " from a full join b on a.a_id = b.a_id and a.b_id = b.b_id and i = j group by 1, 2, 3"
)
def diff_positional(spark, sf_dir):
    return align.diff_by_position(*pairs_of(spark, sf_dir))


@query(f"with {SIDES}{SIZES} select a_id, b_id, shorter as zipped, na - shorter as deleted, nb - shorter as inserted from sizes")
def diff_zip_remainder(spark, sf_dir):
    return align.zip_remainder(*pairs_of(spark, sf_dir))


@query(f"with {HASHED} select doc_id, line_no, cast(count(*) over (partition by doc_id, h) as bigint) as copies from h qualify copies > 1")
def duplicate_paragraphs(spark, sf_dir):
    h = hashed_lines(docs_of(spark, sf_dir))
    return h.withColumn("copies", F.count("*").over(Window.partitionBy("doc_id", "h"))).where("copies > 1").select("doc_id", "line_no", "copies")


def _words(c: str) -> str:
    return f"list_distinct({tok(f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))")})"


MOVES = (
    RUNS + ", best as (select a_id, b_id, i as ri, j as rj, n as rn from runs qualify row_number() over (partition by a_id, b_id order by score desc, n desc, i, j) = 1)"
    f", gone as (select a.a_id, a.b_id, i, {_words('line_a')} as ta, len({tok('line_a')}) as wa from a join best using (a_id, b_id) where not i between ri and ri + rn - 1 and len({tok('line_a')}) >= 6)"
    f", come as (select b.a_id, b.b_id, j, {_words('line_b')} as tb, len({tok('line_b')}) as wb from b join best using (a_id, b_id) where not j between rj and rj + rn - 1 and len({tok('line_b')}) >= 6)"
    ", met as (select a_id, b_id, i, j, len(list_intersect(ta, tb)) as shared_words, len(ta) as na, len(tb) as nb from gone join come using (a_id, b_id) where least(wa, wb) / greatest(wa, wb) >= 0.9)"
    ", cand as (select a_id, b_id, i, j, round(shared_words / (na + nb - shared_words), 6) as similarity from met where shared_words > 0 and round(shared_words / (na + nb - shared_words), 6) >= 0.97)"
)


@query(MOVES + " select * from cand")
def move_candidates(spark, sf_dir):
    return similarity.move_candidates(*pairs_of(spark, sf_dir))


@query(MOVES + " select * from cand qualify row_number() over (partition by a_id, b_id, i order by similarity desc, j) = 1")
def move_best(spark, sf_dir):
    return similarity.best_moves(similarity.move_candidates(*pairs_of(spark, sf_dir)))


@query(None)
def moves(spark, sf_dir):
    return similarity.detect_moves(*pairs_of(spark, sf_dir))


# --- ordered differences, revisions, accept and reject


@query(None)
def diff_blocks(spark, sf_dir):
    return diff.diff(pairs_of(spark, sf_dir)[0], docs_of(spark, sf_dir), detail=False)


@query(None)
def diff_words(spark, sf_dir):
    return diff.diff(pairs_of(spark, sf_dir)[0], docs_of(spark, sf_dir))


def revised(spark, sf_dir):
    return similarity.revised(pairs_of(spark, sf_dir)[0], docs_of(spark, sf_dir))


@query(None)
def revisions(spark, sf_dir):
    return similarity.revision_rows(revised(spark, sf_dir))


@query(None)
def revision_counts(spark, sf_dir):
    return revisions(spark, sf_dir).groupBy("a_id", "b_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(None)
def revision_json(spark, sf_dir):
    return diff.revision_json(revisions(spark, sf_dir))


@query(None)
def revisions_array(spark, sf_dir):
    return similarity.revision_arrays(revised(spark, sf_dir))


def _canonical(side: str) -> str:
    return f"with {PAIRS}, c as (select doc_id, string_agg(line || chr(10), '' order by line_no) as t from lines group by 1) select a_id, b_id, sha1(t) as h, cast(length(t) as bigint) as chars from pairs join c on doc_id = {side}"


@query(_canonical("b_id"))
def accept_text(spark, sf_dir):
    return diff.resolve(diff_words(spark, sf_dir), accept=True).select("a_id", "b_id", F.sha1("text").alias("h"), F.length("text").cast("long").alias("chars"))


@query(_canonical("a_id"))
def reject_text(spark, sf_dir):
    return diff.resolve(diff_words(spark, sf_dir), accept=False).select("a_id", "b_id", F.sha1("text").alias("h"), F.length("text").cast("long").alias("chars"))


@query(None)
def row_lcs(spark, sf_dir):
    return diff.row_lcs(*pairs_of(spark, sf_dir))


@query("with p as (select conv_id, role, lead(turn) over w as turn, text as a_text, lead(text) over w as b_text from conversations window w as (partition by conv_id, role order by turn)) select conv_id, role, turn, a_text = b_text as same, length(b_text) - length(a_text) as grown from p where turn is not null")
def turn_revisions(spark, sf_dir):
    return turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "role", "turn", (F.col("a_text") == F.col("b_text")).alias("same"), (F.length("b_text") - F.length("a_text")).cast("long").alias("grown"))


# --- properties


@query(
    "with e as (select event_id, json_extract_string(props, '$.k') as k, lag(event_type) over w as old_type, event_type, lag(json_extract_string(props, '$.k')) over w as old_k, lag(event_id) over w as prev from events window w as (partition by user_id order by ts, event_id))"
    " select event_id, array_to_string(list_filter([case when old_type is distinct from event_type then 'event_type' end, case when old_k is distinct from k then 'fontSize' end], lambda x: x is not null), ',') as changed from e where prev is not null"
)
def prop_diff(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    props = F.map_filter(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("sz"), F.get_json_object("props", "$.k")), lambda k, v: v.isNotNull())
    e = table(spark, sf_dir, "events").withColumn("p", props)
    e = e.withColumn("old", F.lag("p").over(w)).where(F.col("old").isNotNull())
    names = F.transform(relations.map_difference(F.col("old"), F.col("p")), T.friendly_name)
    return e.select("event_id", F.array_join(F.array_sort(names), ",").alias("changed"))


# --- state


@query("select user_id, event_id, ts, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_wins(spark, sf_dir):
    return state.latest_wins(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_id", "ts", "event_type", "value"])


@query("select event_id, user_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as n, n <= 5 as granted from events")
def quota_grants(spark, sf_dir):
    return state.grants(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id", "n", "granted")


@query("select user_id, least(count(*), 5) as used, greatest(0, 5 - least(count(*), 5)) as remaining, count(*) >= 5 as paywalled from events group by 1")
def quota_view(spark, sf_dir):
    return state.quota_view(table(spark, sf_dir, "events"), "user_id", 5)


@query(
    "with s as (select o_orderkey, o_orderdate as d, case when o_orderstatus = 'F' then o_orderdate + interval 30 day end as revoked, case when o_orderpriority <> '5-LOW' then o_orderdate + interval 365 day end as expires, o_orderdate + interval 400 day as grace, timestamp '1995-06-17' as t from orders)"
    " select o_orderkey, case when revoked is not null and revoked <= t then false when expires is null then true when expires > t then true else grace > t end as entitled from s"
)
def entitlement_case(spark, sf_dir):
    d = F.col("o_orderdate")
    later = lambda days: d + F.make_interval(days=F.lit(days))
    revoked, expires = F.when(F.col("o_orderstatus") == "F", later(30)), F.when(F.col("o_orderpriority") != "5-LOW", later(365))
    now = F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.entitled(revoked, expires, later(400), now).alias("entitled"))


# --- statistics


@query(
    "with m as (select o_orderpriority, count(*) as n, median(o_totalprice) as md from orders group by 1)"
    " select o_orderpriority, n, round(md, 4) as median, round(median(abs(o_totalprice - md)), 4) as mad from orders join m using (o_orderpriority) group by o_orderpriority, n, md"
)
def stats_median_mad(spark, sf_dir):
    s = stats.median_mad(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return s.select("o_orderpriority", "n", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95 from lineitem group by 1")
def stats_percentiles(spark, sf_dir):
    q = stats.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.95])
    return q.select("l_returnflag", *[F.round(F.col("q")[k], 4).alias(f"p{p}") for k, p in enumerate((10, 50, 95))])


@query(
    "with t as (select o_custkey, case when o_orderstatus = 'F' then 'A' else 'B' end as side, o_totalprice as v from orders), m as (select o_custkey, side, count(*) as n, median(v) as md from t group by 1, 2)"
    ", s as (select o_custkey, side, n, md, median(abs(v - md)) as mad from t join m using (o_custkey, side) group by 1, 2, 3, 4), a as (select * from s where side = 'A'), b as (select * from s where side = 'B')"
    " select coalesce(a.o_custkey, b.o_custkey) as o_custkey, round(a.md, 6) as median_a, round(b.md, 6) as median_b, case when a.n is null or b.n is null then 'insufficient' when b.md - a.md > greatest(0.05 * a.md, 1.5 * a.mad) then 'regress'"
    " when b.md - a.md < -greatest(0.05 * a.md, 1.5 * a.mad) then 'improve' else 'noise' end as verdict from a full join b on a.o_custkey = b.o_custkey"
)
def trial_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("side"), F.col("o_totalprice").alias("v"))
    return stats.verdicts(o, "o_custkey", "side", "v")


@query(
    "with a as (select l_suppkey, avg(l_quantity) as s from lineitem where l_returnflag = 'A' group by 1), b as (select l_suppkey, avg(l_quantity) as s from lineitem where l_returnflag = 'R' group by 1)"
    " select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, round(a.s, 6) as score_a, round(b.s, 6) as score_b, round(b.s - a.s, 6) as delta, case when b.s is null then 'only_a' when a.s is null then 'only_b' when b.s < a.s - 1 then 'drop' when b.s > a.s + 1 then 'rise' else 'same' end as kind from a full join b on a.l_suppkey = b.l_suppkey"
)
def ledger_compare(spark, sf_dir):
    of = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.avg("l_quantity").alias("s"))
    return stats.compare_ledgers(of("A"), of("R"), "l_suppkey", "s", 1.0)


@query(
    "with a as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'A'), b as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R')"
    " select *, 'NEW' as change from (select * from b except select * from a) union all select *, 'FIXED' as change from (select * from a except select * from b)"
)
def ratchet_new_fixed(spark, sf_dir):
    of = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey")
    return stats.ratchet(of("A"), of("R"))


@query(
    "with c as (select case when text like '% | %' then 'table' when text like '%!!%' then 'shout' when length(text) < 100 then 'short' when lang <> 'en' then 'foreign' else 'prose' end as class, coalesce(quality, -1) as quality from documents left join labels using (doc_id))"
    " select class, quality, count(*) as n from c group by 1, 2"
)
def classify_first_match(spark, sf_dir):
    t = F.col("text")
    rules = [(F.contains(t, F.lit(" | ")), "table"), (F.contains(t, F.lit("!!")), "shout"), (F.length(t) < 100, "short"), (F.col("lang") != "en", "foreign")]
    d = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy(stats.first_match(rules, "prose").alias("class"), F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"))


@query("with n as (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as name from pages) select name, count(*) as n, count(distinct page_id) as pages from n group by 1")
def inventory_counts(spark, sf_dir):
    names = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("name")
    return table(spark, sf_dir, "pages").select("page_id", names).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query(
    "with a as (select distinct l_suppkey from lineitem where l_shipdate < timestamp '1995-01-01'), b as (select distinct l_suppkey from lineitem where l_shipdate >= timestamp '1995-01-01')"
    " select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, case when b.l_suppkey is null then 'left' when a.l_suppkey is null then 'right' else 'both' end as side from a full join b on a.l_suppkey = b.l_suppkey"
)
def set_only_left_right(spark, sf_dir):
    early = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    side = F.when(F.bool_and(early), "left").when(F.bool_and(~early), "right").otherwise("both")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(side.alias("side"))


# --- keyed sets, intervals, chains


@query("select c_custkey, c_nationkey from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
def copy_missing(spark, sf_dir):
    target = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return relations.copy_missing(target, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"]).select("c_custkey", "c_nationkey")


@query("select doc_id, quality from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def dangling_refs(spark, sf_dir):
    known = docs_of(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("known"))
    return relations.dangling(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", known, "known").select("doc_id", "quality")


@query(
    f"with {LINES}, s as (select doc_id, line_no, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as s, length(line) as n from lines)"
    ", r as (select doc_id, cast(n_chars * 0.25 as bigint) as r_s, cast(n_chars * 0.75 as bigint) as r_e from documents)"
    " select doc_id, line_no, greatest(s, r_s) as from_char, least(s + n, r_e) as to_char from s join r using (doc_id) where n > 0 and r_e > r_s and s < r_e and r_s < s + n"
)
def interval_join(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    s = islands.running_offset(lines(docs), ["doc_id"], ["line_no"], F.length("line") + 1, "s").select("doc_id", "line_no", F.col("s").cast("long").alias("s"), (F.col("s") + F.length("line")).cast("long").alias("e"))
    part = lambda x: F.round(F.col("n_chars") * x).cast("long")
    r = docs.select("doc_id", part(0.25).alias("r_s"), part(0.75).alias("r_e"))
    met = relations.overlapping(s, r, "doc_id", "s", "e", "r_s", "r_e", 4096)
    return met.select("doc_id", "line_no", F.greatest("s", "r_s").alias("from_char"), F.least("e", "r_e").alias("to_char"))


def _context(n: int) -> str:
    tail = f"right(before, {n})" if n else "''"
    return f"case when instr(text, {tail} || needle) > 0 then instr(text, {tail} || needle) + length({tail}) end"


@query(
    f"with {LINES}, w as (select l.doc_id, l.line_no, d.text, l.line as needle, coalesce(lag(l.line) over (partition by l.doc_id order by l.line_no), '') || chr(10) as before from lines l join documents d using (doc_id))"
    f" select doc_id, line_no, cast(coalesce({_context(40)}, {_context(20)}, {_context(10)}, {_context(0)}, 0) as bigint) as at from w"
)
def context_locate(spark, sf_dir):
    # a text is there once, and its lines are looked for in it where it is
    visible = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    before = lambda k: F.concat(F.coalesce(F.try_element_at("l", F.when(k > 0, k).cast("int")), F.lit("")), F.lit("\n"))
    docs = docs_of(spark, sf_dir).select("doc_id", "text", visible.alias("l"))
    places = F.transform("l", lambda line, k: relations.locate_in_context(F.col("text"), before(k), line).cast("long"))
    return docs.select("doc_id", F.posexplode(places).alias("line_no", "at"))


@query(
    "with recursive e as (select 'R' || r_regionkey as node, cast(null as varchar) as up from region union all select 'N' || n_nationkey, 'R' || n_regionkey from nation union all select 'S' || s_suppkey, 'N' || s_nationkey from supplier union all select 'C' || c_custkey, 'N' || c_nationkey from customer)"
    ", c as (select node, node as root, up, 0 as depth from e union all select c.node, c.up, e.up, depth + 1 from c left join e on e.node = c.up where c.up is not null)"
    " select node, root, depth from c where up is null"
)
def chain_resolve(spark, sf_dir):
    t = lambda name, a, b, c, d: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(b)).alias("node"), (F.concat(F.lit(c), F.col(d)) if c else F.lit(None).cast("string")).alias("up"))
    e = t("region", "R", "r_regionkey", "", "").union(t("nation", "N", "n_nationkey", "R", "n_regionkey"))
    e = e.union(t("supplier", "S", "s_suppkey", "N", "s_nationkey")).union(t("customer", "C", "c_custkey", "N", "c_nationkey"))
    return relations.resolve_chains(e, "node", "up", most=4)


@query(
    f"with {LINES}, m as (select *, case when contains(line, ' | ') = lag(contains(line, ' | ')) over (partition by doc_id order by line_no) then 0 else 1 end as b from lines)"
    ", g as (select *, sum(b) over (partition by doc_id order by line_no rows unbounded preceding) - 1 as run from m)"
    " select doc_id, cast(run as bigint) as run, bool_and(contains(line, ' | ')) as is_table, count(*) as n, left(string_agg(line, chr(10) order by line_no), 200) as preview from g group by 1, 2"
)
def preview_runs(spark, sf_dir):
    marked = lines(docs_of(spark, sf_dir)).withColumn("is_table", F.contains("line", F.lit(" | ")))
    g = islands.group_adjacent(marked, ["doc_id"], ["line_no"], "is_table", "run")
    # of a run's lines only those that begin within the preview are gathered
    g = islands.running_offset(g, ["doc_id", "run"], ["line_no"], F.length("line") + 1, "at")
    head = F.collect_list(F.when(F.col("at") <= 200, F.struct("line_no", F.left("line", F.lit(200)).alias("line"))))
    text = F.array_join(F.transform(F.array_sort(head), lambda x: x["line"]), "\n")
    return g.groupBy("doc_id", "run").agg(F.bool_and("is_table").alias("is_table"), F.count("*").alias("n"), F.left(text, F.lit(200)).alias("preview"))


# --- the star schema, as a smoke test of the built-in operators


@query(
    "select n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_shipdate >= timestamp '1995-01-01' group by 1"
)
def revenue_by_nation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    joined = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


from palimpsest.plans import inventory, structure  # noqa: E402, F401  (register their queries)
