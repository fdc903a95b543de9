"""Queries over repair, citations and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantables.operators import changes, cite, repair
from plantables.plans.registry import add
from plantables.sources import roles
from plantables.sources.roles import oracle, table


def plan(s, d, *more: str):
    return roles.plan_item(s, d).selectExpr("*", "id as ordinal", *more)


SPARSE = "case when id % 3 = 0 then null else credits end"

add(
    "r1_merge_chunks",
    lambda s, d: repair.merge_chunks(plan(s, d).select("program", "code", "year", "semester", "ordinal", "credits", "pages"), ["program", "code", "year", "semester"]),
    oracle(
        "select program, code, year, semester, min(id) as ordinal, arg_min(credits, id) as credits, coalesce(list_sort(list_distinct(flatten(list(pages) filter (pages is not null)))), []::int[]) as pages from plan_item group by program, code, year, semester"
    ),
)
add(
    "r2_dedupe_fill",
    lambda s, d: repair.dedupe_fill(plan(s, d, f"{SPARSE} as c", "case when id % 2 = 0 then '' else category end as k"), ["program", "code"], ["c", "k"]),
    oracle(f"select program, code, min(id) as ordinal, arg_min({SPARSE}, id) filter ({SPARSE} is not null) as c, arg_min(category, id) filter (id % 2 <> 0) as k from plan_item group by program, code"),
)
#: Names of plan rows: numbered within 1 to 20 and beyond, or not.
NAMED = "case when id % 3 = 0 then 'Elective ' || id % 23 else 'Elective' end"
add(
    "r2_suffix_wildcards",
    lambda s, d: repair.suffix_wildcards(plan(s, d, f"{NAMED} as name"), ["program", "edition", "track"], ["year", "category", "name"]).select("id", "code"),
    oracle(
        f""", p as (select *, {NAMED} as name from plan_item), t as (select program, edition, track, code, year, category, name, min(id) as f, max(case when id % 3 = 0 and id % 23 between 1 and 20 then id % 23 end) as a from p where starts_with(code, 'PLACEHOLDER_') group by all),
m as (select *, case when a is not null and row_number() over (partition by program, edition, track, code, a order by f) = 1 then a end as n from t),
l as (select program, edition, track, code, list(n) filter (n is not null) as taken from m group by all),
u as (select *, row_number() over (partition by program, edition, track, code order by f) as k from m where n is null),
g as (select program, edition, track, code, v, row_number() over (partition by program, edition, track, code order by v) as k from (select program, edition, track, code, taken, unnest(range(1, 2000)) as v from l) where taken is null or not list_contains(taken, v)),
z as (select program, edition, track, code, year, category, name, n from m where n is not null union all select program, edition, track, code, year, category, name, v from u join g using (program, edition, track, code, k))
select p.id, case when n > 1 then code || '_' || n else code end as code from p left join z using (program, edition, track, code, year, category, name)"""
    ),
)
#: What was read of a code: nothing, its last four digits, one digit too few, letters, a wildcard, digits of another code, or the code.
READ_CODE = "case p_partkey % 8 when 0 then '' when 1 then right(c, 4) when 2 then left(c, 3) || substring(c, 5) when 3 then '9x' when 4 then 'PLACEHOLDER_0603XXXX' when 5 then '1' || right(c, 6) when 6 then null else c end"
add(
    "r4_recover_codes",
    lambda s, d: repair.recover_codes(
        table(s, d, "part").selectExpr("*", "lpad('' || p_partkey, 8, '0') as c").selectExpr("p_partkey", f"{READ_CODE} as code", "case when p_partkey % 3 = 0 then 'new ' else '' end || p_name || ' ' || p_partkey as name"),
        table(s, d, "part").filter("p_partkey % 5 > 0").selectExpr("p_name || p_partkey as name", "lpad('' || p_partkey, 8, '0') as code"),
    ).select("p_partkey", "code", "recovered"),
    f"""with p as (select p_partkey, lpad('' || p_partkey, 8, '0') as c, replace(case when p_partkey % 3 = 0 then 'new' else '' end || p_name || p_partkey, ' ', '') as b from part), q as (select *, {READ_CODE} as code from p),
k as (select c as kc, b as kb from (select c, replace(p_name || p_partkey, ' ', '') as b from part join p using (p_partkey) where p_partkey % 5 > 0) where length(b) >= 10),
m as (select p_partkey, min(kc) as one, count(distinct kc) as n from q join k on ends_with(b, kb) where coalesce(code, '') = '' or (regexp_full_match(code, '[0-9]+') and length(code) <> 8 and regexp_matches(kc, array_to_string(string_split(code, ''), '.*'))) group by p_partkey)
select p_partkey, case when n = 1 then one else code end as code, coalesce(n = 1, false) as recovered from q left join m using (p_partkey)""",
)
add(
    "r5_backfill",
    lambda s, d: repair.backfill(plan(s, d, f"{SPARSE} as c"), ["program", "code", "year", "semester"], ["c"]).select("id", "c"),
    oracle(f"select id, coalesce({SPARSE}, first_value({SPARSE} ignore nulls) over (partition by program, code, year, semester order by id rows between unbounded preceding and unbounded following)) as c from plan_item"),
)
add(
    "r6_fill_from_real",
    lambda s, d: repair.fill_from_real(plan(s, d, "case when alt_group is null then credits when id % 2 = 0 then credits end as c", "category as name").select("program", "id", "alt_group", "code", "name", "c"), ["program"], ["c"]).select("id", "c"),
    oracle(
        """, p as (select *, case when alt_group is null or id % 2 = 0 then credits end as c from plan_item), r as (select program, code, case when count(distinct c) = 1 then min(c) end as v from p where alt_group is null group by all), n as (select program, alt_group, count(distinct category) = 1 as o from p where alt_group is not null group by all)
select id, case when c is null and o then v else c end as c from p left join r using (program, code) left join n using (program, alt_group)"""
    ),
)
#: Names read for a code: its own in two spellings, or its neighbour's, by description or table.
READ = [
    "lpad('' || l_partkey % 500, 8, '0') as code",
    "case when l_linenumber = 1 or l_suppkey % 3 = 0 then 'N ' || l_partkey % 500 when l_suppkey % 3 = 1 then 'n' || (l_partkey % 500 + 1) else 'other ' || l_partkey % 2 end as name",
    "case when l_linenumber = 1 then 'description' else 'table' end as source",
]
add(
    "r7_vote_names",
    lambda s, d: repair.vote_names(table(s, d, "lineitem").selectExpr(*READ)),
    f"""with r as (select {', '.join(READ)} from lineitem), k as (select *, lower(replace(name, ' ', '')) as key from r), d as (select distinct code, key from k where source = 'description'),
o as (select * from k where key not in (select key from d) or (code, key) in (select (code, key) from d)),
c as (select code, key, count(*) as n, max(cast(source = 'description' as int)) as d, min(name) as name from o group by all) select code, name, n from (select *, row_number() over (partition by code order by n desc, d desc, name) as r from c) where r = 1""",
)
add(
    "r12_impute_neighbours",
    lambda s, d: repair.impute_from_neighbours(roles.course(s, d).filter("code like '0%'").selectExpr("code", "case when cast(code as int) % 5 = 0 then null when cast(code as int) % 40 < 20 then 3 else credits end as credits")),
    oracle(
        """, c as (select code, case when cast(code as int) % 5 = 0 then null when cast(code as int) % 40 < 20 then 3 else credits end as credits from course where code like '0%'),
n as (select *, list_filter([lag(credits, 1) over w, lag(credits, 2) over w, lead(credits, 1) over w, lead(credits, 2) over w], lambda x: x is not null) as l from c window w as (partition by substring(code, 1, 6) order by code)),
m as (select *, case when len(l) >= 3 and len(list_distinct(l)) = 1 then l[1] end as v from n) select code, coalesce(credits, v) as credits, credits is null and v is not null as imputed from m"""
    ),
)
#: Series of an order, by category: equal credits, credits that grow with the number, and both mixed.
SERIES = "case category when 'A' then '3(3-0-6)' when 'N' then year || '(0-' || 2 * year || '-' || year || ')' else case when id % 2 = 0 then '3(3-0-6)' else year || '(0-' || 2 * year || '-' || year || ')' end end"
add(
    "r13_impute_series",
    lambda s, d: repair.impute_from_series(plan(s, d, f"case when id % 3 > 0 then {SERIES} end as c", "category || ' ' || year as name").selectExpr("cast(floor(id / 1000) as bigint) as k", "id", "name", "c as credits"), ["k"]).select("id", "credits", "imputed"),
    oracle(
        f""", p as (select cast(floor(id / 1000) as bigint) as k, category, id, year, case when id % 3 > 0 then {SERIES} end as c from plan_item), q as (select *, c = year || '(0-' || 2 * year || '-' || year || ')' as grows from p),
g as (select k, category, count(c) as n, min(c) as lo, max(c) as hi, bool_and(grows) filter (c is not null) as all_grow from q group by all)
select id, case when c is not null or n = 0 then c when all_grow then year || '(0-' || 2 * year || '-' || year || ')' when lo = hi then lo end as credits, c is null and n > 0 and (all_grow or lo = hi) as imputed from q join g using (k, category)"""
    ),
)
add(
    "r16_null_inferred",
    lambda s, d: repair.null_inferred(plan(s, d, "id % 5 = 0 as inferred").select("program", "id", "code", "credits", "inferred"), roles.course(s, d).filter("credits > 6"), ["code"]).select("id", "credits"),
    oracle("select id, case when id % 5 = 0 and code not in (select code from course where credits > 6) then null else credits end as credits from plan_item"),
)
BY = ["program", "edition", "track", "year", "semester", "category"]
def _printed_totals(s, d):
    """What a term prints: its credits, one more in year 3; two totals in year 2."""
    group = F.coalesce("alt_group", F.concat(F.lit("x"), F.col("id")))
    made = plan(s, d).groupBy(*BY, group.alias("g")).agg(F.max("credits").alias("c")).groupBy(*BY).agg((F.sum("c") + F.when(F.col("year") == 3, 1).otherwise(0)).alias("total"))
    return made.unionByName(plan(s, d).filter("year = 2").select(*BY).distinct().withColumn("total", F.lit(1).cast("long")))


add(
    "r17_corroborated",
    lambda s, d: repair.corroborated(plan(s, d, "id % 5 = 0 as inferred").select(*BY, "id", "alt_group", "credits", "inferred"), _printed_totals(s, d), BY),
    oracle(f"select {', '.join(BY)}, id from plan_item where id % 5 = 0 and year not in (2, 3)"),
)
add(
    "r24_dissolve_mixed_groups",
    lambda s, d: repair.dissolve_mixed_groups(plan(s, d), ["program", "year", "semester"]).select("id", "alt_group"),
    oracle("select id, case when min(category) over w = max(category) over w then alt_group end as alt_group from plan_item window w as (partition by program, year, semester, alt_group)"),
)
add(
    "r25_post_clean",
    lambda s, d: repair.post_clean(
        plan(s, d).selectExpr("cast(floor(id / 4000) as bigint) as k", "id as ordinal", "case when id % 6 = 0 then 'PLACEHOLDER_0603XXXX_' || id % 3 when id % 6 = 1 then 'PLACEHOLDER_0603XXXX' else right(code, 7) end as code", "case when id % 5 = 0 then '0603xxxx' when id % 6 < 2 then 'Elective' else category end as name", "'3' as credits", "alt_group", "year", "semester"),
        ["k"], s.createDataFrame([("0000013",), ("0000077",)], "code string"),
    ).select("ordinal", "rule"),
    oracle(
        """, p as (select cast(floor(id / 4000) as bigint) as k, id, case when id % 6 = 0 then 'PLACEHOLDER_0603XXXX_' || id % 3 when id % 6 = 1 then 'PLACEHOLDER_0603XXXX' else right(code, 7) end as code, case when id % 5 = 0 then '0603xxxx' when id % 6 < 2 then 'Elective' else category end as name, alt_group, year, semester from plan_item),
a as (select *, starts_with(code, 'PLACEHOLDER') as h from p), b as (select *, h and name = '0603xxxx' as bare from a),
c as (select *, not bare and h and alt_group is null and regexp_matches(code, '_[0-9]+$') and exists (select 1 from b o where not o.bare and o.k = b.k and o.year = b.year and o.semester = b.semester and o.code = regexp_replace(b.code, '_[0-9]+$', '') and o.name = b.name) as twin from b),
e as (select *, not h and alt_group is null as real from c), f as (select *, max(year * 10 + semester) over (partition by k, code, real) as last, min(year * 10 + semester) over (partition by k, code, real) as first, row_number() over (partition by k, code, real order by year * 10 + semester desc, id) as r from e)
select id as ordinal, case when bare then 'bare code' when twin then 'numbered copy' when real and first <> last and r > 1 then 'earlier term' when code in ('0000013', '0000077') then 'listed' end as rule from f"""
    ),
)
add(
    "r26_drop_junk",
    lambda s, d: repair.drop_junk(plan(s, d, "case when id % 7 = 0 then 'Total 21' when id % 7 = 1 then code || ' 3(3-0-6)' else category || code end as name"), "(?i)^total").select("id", "name"),
    oracle(", n as (select id, case when id % 7 = 0 then 'Total 21' when id % 7 = 1 then code || ' 3(3-0-6)' else category || code end as name from plan_item) select * from n where id % 7 > 1 or (id % 7 = 1 and starts_with(name, 'P'))"),
)
add(
    "r27_apply_overrides",
    lambda s, d: repair.apply_overrides(plan(s, d).select("id", "code", "credits"), roles.course(s, d).selectExpr("code", "credits = 0 as drop", "case when credits > 8 then 8 end as credits"), ["code"], ["credits"]),
    oracle("select id, code, coalesce(case when c.credits > 8 then 8 end, p.credits) as credits from plan_item p left join (select code, credits from course) c using (code) where c.credits is null or c.credits <> 0"),
)
add(
    "r29_order_slots",
    lambda s, d: repair.order_slots(plan(s, d, "category || type as name", "'xxAF AO NF NO RF RO' as page_text").withColumn("page", F.col("pages")[0]).filter("code like 'PLACEHOLDER%'"), ["program"]).select("id", "place"),
    oracle("select id, cast(row_number() over (partition by program, code order by pages[1] nulls last, instr('xxAF AO NF NO RF RO', category || type), id) as int) as place from plan_item where starts_with(code, 'PLACEHOLDER')"),
)
add(
    "r30_longest_of_series",
    lambda s, d: repair.longest_of_series(plan(s, d, "case when id % 3 = 0 then '3(3-0-6) or 3(2-2-5)' when id % 3 = 1 then '3(3-0-6)' else '2(2-0-4)' end as t").filter("alt_group is not null"), ["program", "alt_group"], "t").select("id", "t"),
    oracle(
        """, p as (select program, alt_group, id, case when id % 3 = 0 then '3(3-0-6) or 3(2-2-5)' when id % 3 = 1 then '3(3-0-6)' else '2(2-0-4)' end as t from plan_item where alt_group is not null),
b as (select *, first_value(t) over (partition by program, alt_group order by length(t) desc, t) as m from p) select id, case when list_has_all(string_split(m, ' '), string_split(t, ' ')) then m else t end as t from b"""
    ),
)
add(
    "d3_description_prerequisites",
    lambda s, d: repair.description_prerequisites(plan(s, d).selectExpr("program as doc_id", "category as code", "id as line_no", "case when id % 50 = 0 then 'Prerequisite: none' when id % 50 = 1 then 'PREREQUISITE : see ' || code || ' and 0123' else 'text ' || code end as line")),
    oracle(
        ", l as (select program, category, id, case when id % 50 = 1 and regexp_full_match(code, '[0-9]{8}') then code else '' end as c from plan_item where id % 50 < 2) select program as doc_id, category as code, coalesce(arg_min(c, id) filter (c <> ''), '') as prerequisite from l group by all"
    ),
)
add(
    "d4_apply_prerequisites",
    lambda s, d: repair.apply_prerequisites(plan(s, d).selectExpr("id", "code", "pages", "'none' as prerequisite"), roles.course(s, d).selectExpr("code", "case when credits > 3 then '' || credits end as prerequisite", "pages"), ["code"]).select("id", "prerequisite", "pages"),
    oracle("select id, coalesce(case when c.credits > 3 then '' || c.credits end, 'none') as prerequisite, list_sort(list_distinct(list_concat(coalesce(p.pages, []::int[]), coalesce(c.pages, []::int[])))) as pages from plan_item p left join (select code, credits, pages from course) c using (code)"),
)
add(
    "d5_terms_by_prefix",
    lambda s, d: repair.terms_by_prefix(roles.course(s, d), table(s, d, "lineitem").selectExpr("substring(lpad('' || l_partkey, 8, '0'), 1, cast(5 + l_orderkey % 3 as int)) || 'XXX' as code", "(l_orderkey % 4 + 1) || '/' || (l_linenumber % 3 + 1) as term")),
    oracle(
        """, s as (select distinct substring(lpad('' || l_partkey, 8, '0'), 1, cast(5 + l_orderkey % 3 as int)) as prefix, (l_orderkey % 4 + 1) || '/' || (l_linenumber % 3 + 1) as term from lineitem)
select code, string_agg(distinct term, ', ' order by term) as terms from course join s on starts_with(code, prefix) group by code"""
    ),
)
add("d6_variant_only_codes", lambda s, d: repair.only_in(roles.plan_item(s, d).withColumn("code", F.concat_ws("-", "code", "program", "year")), "track", 0, 1), oracle("select code || '-' || program || '-' || year as code from plan_item where track = 0 except select code || '-' || program || '-' || year from plan_item where track = 1"))
add(
    "d7_category_by_prefix",
    lambda s, d: repair.category_by_prefix(roles.course(s, d).selectExpr("code", "case when credits > 9 then 'own' end as category"), roles.plan_item(s, d), 7).select("code", "category"),
    oracle(
        """, n as (select substring(code, 1, 7) as prefix, category, count(*) as n from plan_item where regexp_full_match(code, '[0-9]{8}') group by all), b as (select * from (select *, row_number() over (partition by prefix order by n desc, category) as r from n) where r = 1)
select code, coalesce(case when credits > 9 then 'own' end, b.category) as category from course c left join b on b.prefix = substring(c.code, 1, 7)"""
    ),
)

add(
    "d7_category_for_code",
    lambda s, d: repair.category_for_code(
        plan(s, d).selectExpr("id", "code", "'course ' || case id % 4 when 0 then 'Elective' when 1 then 'free' else '' end as name", "case when id % 5 = 0 then 'elective group' when id % 5 = 1 then 'core' end as group", "alt_group", "case when id % 3 > 0 then year end as year", "semester", "case when id % 6 = 0 then 'own' end as category"),
        roles.course(s, d).selectExpr("code", "case when credits > 9 then 'c' || credits end as category"), {"free": "Free", "Elec": "Chosen"}, {"0000000": "Zero", "0000": "Low", "PLACE": "Wild"}, 7,
    ).select("id", "category", "type"),
    oracle(
        """, n as (select substring(code, 1, 7) as prefix, 'c' || credits as category, count(*) as n from course where regexp_full_match(code, '[0-9]{8}') and credits > 9 group by all), b as (select * from (select *, row_number() over (partition by prefix order by n desc, category) as r from n) where r = 1),
p as (select *, regexp_full_match(code, '[0-9]{8}') as real from plan_item)
select id, coalesce(case when id % 6 = 0 then 'own' end, b.category, case id % 4 when 0 then 'Chosen' when 1 then 'Free' end, case when code like '0000000%' then 'Zero' when code like '0000%' then 'Low' when code like 'PLACE%' then 'Wild' end) as category,
case when alt_group is not null and id % 3 > 0 and real then 'required' when not real or id % 5 = 0 or (id % 5 > 1 and id % 4 = 0) then 'elective' else 'required' end as type from p left join b on b.prefix = substring(p.code, 1, 7)"""
    ),
)

add(
    "n2_resolve_names",
    lambda s, d: cite.resolve_names(table(s, d, "part").selectExpr("case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name || ' ' || p_brand, ' ', '  ') when 2 then p_brand || 'z' else substring(p_name || p_brand, 3, 12) end as name"), roles.course(s, d).selectExpr("name_th as alias", "code").union(roles.course(s, d).selectExpr("name_en as alias", "code"))),
    oracle(
        """, l as (select distinct lower(replace(a, ' ', '')) as k, code from (select name_th as a, code from course union all select name_en, code from course)), q as (select distinct case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name || ' ' || p_brand, ' ', '  ') when 2 then p_brand || 'z' else substring(p_name || p_brand, 3, 12) end as name from part), b as (select name, lower(replace(name, ' ', '')) as k from q),
u as (select k, list_sort(list_distinct(list(code))) as c from l group by k), k2 as (select distinct b.k from b where k not in (select k from u)), w as (select k2.k, list_sort(list_distinct(flatten(list(u.c)))) as c from k2 join u on contains(u.k, k2.k) group by k2.k)
select name, coalesce(u.c, w.c, []::varchar[]) as codes, case when len(coalesce(u.c, w.c)) = 1 then coalesce(u.c, w.c)[1] end as code, case when coalesce(u.c, w.c) is null then 'none' when len(coalesce(u.c, w.c)) = 1 then 'unique' else 'ambiguous' end as status from b left join u using (k) left join w on w.k = b.k"""
    ),
)
CITED = "case when id % 10 = 0 then '[' || (id * 3 % 200 + 1) || ', 0]' when id % 10 = 1 then 'page 7' else '[' || pages[{}] || ']' end"
add(
    "n3_citations",
    lambda s, d: cite.citations(
        plan(s, d).selectExpr("id", "code", "case when id % 7 > 0 then year end as year", "cast(case when id % 6 = 0 then 3 else semester end as int) as semester", f"{CITED.format(0)} as pages"),
        roles.plan_item(s, d).selectExpr("code", "case when id % 7 > 0 then year end as year", "semester", "pages"),
        roles.course(s, d),
    ),
    oracle(
        f""", e as (select id, code, case when id % 7 > 0 then year end as year, case when id % 6 = 0 then 3 else semester end as semester, case when id % 10 = 0 then cast(id * 3 % 200 + 1 as int) when id % 10 <> 1 then pages[1] end as page from plan_item),
p as (select distinct code, case when id % 7 > 0 then year end as year, semester, pages[1] as page, true as h from plan_item where pages is not null), c as (select distinct code, pages[1] as page, true as k from course)
select id, case when h then 'plan_item' when k then 'course' else 'unknown' end as owner, [e.page] as pages from e left join p on p.code = e.code and p.page = e.page and p.year is not distinct from e.year and p.semester is not distinct from e.semester left join c on c.code = e.code and c.page = e.page where e.page is not null"""
    ),
)
add(
    "n4_pages_of",
    lambda s, d: cite.pages_of(roles.plan_item(s, d).join(roles.course(s, d).select("code", F.col("pages").alias("course_pages")), "code", "left"), ["program", "year", "category"], ["pages", "course_pages"]),
    oracle("select program, year, category, list_sort(list_distinct(flatten([coalesce(flatten(list(p.pages) filter (p.pages is not null)), []::int[]), coalesce(flatten(list(c.pages) filter (c.pages is not null)), []::int[])]))) as pages from plan_item p left join (select code, pages from course) c using (code) group by all"),
)
def _page_map(s, d):
    own = plan(s, d).selectExpr("program as doc", "pages[0] as page").filter("page is not null").distinct().selectExpr("doc", "case when page % 5 = 0 then page + 1000 else page end as page")
    return own.selectExpr("doc", "page", "case when page % 7 = 0 then page + 40 end as pdf_page", "case when page % 3 = 0 then 'p.' || page end as label", "page % 2 = 0 as marked", "page % 4 > 0 as content_verified")


add(
    "n5_enrich_citations",
    lambda s, d: cite.enrich_citations(
        plan(s, d).filter("pages is not null").selectExpr("program as doc", "year", "semester", "array(pages[0], pages[0] + 1 - semester % 2) as pages").distinct(),
        s.createDataFrame([(f"P{i}", 100 + 20 * i, b) for i, b in enumerate(("pdf", "printed", None, "unknown", "unknown"))], "doc string, n_pages int, basis string"), _page_map(s, d), ["year", "semester"],
    ),
    oracle(
        """, c as (select distinct program as doc, year, semester, [pages[1], pages[1] + 1 - semester % 2] as pages from plan_item where pages is not null), i as (select doc, 'ref-' || substring(sha256(doc || '|' || year || '|' || semester || '|' || pages[1] || ',' || pages[2]), 1, 16) as id, pages from c),
e as (select distinct doc, id, unnest(pages) as page from i), m as (select distinct program as doc, pages[1] + case when pages[1] % 5 = 0 then 1000 else 0 end as page from plan_item where pages is not null),
j as (select e.*, m.page is not null as known, case doc when 'P0' then 'pdf' when 'P1' then 'printed' else 'unknown' end as b, 100 + 20 * cast(substring(doc, 2) as int) as n from e left join m using (doc, page)),
k as (select *, known and page % 2 = 0 as marked, min(cast(known and page % 2 = 0 as int)) over (partition by doc, id) as every from j), t as (select *, case when b = 'unknown' and every = 1 then 'pdf' else b end as basis, case when b = 'unknown' and marked then 'pdf' else b end as y from k),
p as (select *, case when known and page % 7 = 0 then page + 40 when y = 'pdf' then page end as x from t), q as (select *, case when x <= n then x end as pdf_page from p), v as (select *, pdf_page is not null and known and page % 4 > 0 as verified from q)
select doc, id, basis, page, pdf_page, case when known and page % 3 = 0 then 'p.' || page when y = 'printed' then '' || page end as label, verified, bool_and(verified) over (partition by doc, id) as all_verified from v"""
    ),
)
add(
    "n6_confirm_claims",
    lambda s, d: cite.confirm_claims(roles.course(s, d).selectExpr("code", "array(lecture_h, lab_h, self_h, 1) as claimed", "array(1, 2, 5, credits) as evidence")),
    oracle("select code, list_sort(list_distinct(list_filter([lecture_h, lab_h, self_h, 1], lambda x: x in (1, 2, 5) or coalesce(x = credits, false)))) as confirmed, list_sort(list_distinct(list_filter([lecture_h, lab_h, self_h, 1], lambda x: not (x in (1, 2, 5) or coalesce(x = credits, false))))) as invented from course"),
)


#: Parts in blocks of 20 as random trees: a node hangs below one of the block before it, so depths are mixed. Leaves of every eighth number are given by nobody.
BLOCK = "cast(floor(p_partkey / 20) as bigint)"
_BELOW = "p_partkey % 20 > 0"
_PARENT = f"{BLOCK} * 20 + cast(floor(((p_partkey * 7919 + 13) % 101) * (p_partkey % 20) / 101.0) as bigint)"
_OP = "case when ({p} * 31 + 7) % 5 < 2 then 'all_of' else 'any_of' end"
_VALUE = "case when (k + node * 3) % 4 = 0 then null else (k * 5 + node) % 3 > 0 end"


def _requirements(s, d):
    nodes = table(s, d, "part").selectExpr("p_partkey as node", f"case when {_BELOW} then {_PARENT} end as parent").withColumn("op", F.when(F.col("parent").isNotNull(), F.expr(_OP.format(p="parent"))))
    asked = table(s, d, "customer").selectExpr("c_custkey as student", "c_nationkey as k", "c_custkey % 10 * 20 as top")
    leaves = asked.join(nodes.selectExpr("node", "cast(floor(node / 20) as bigint) * 20 as top"), "top").filter("node % 8 > 0").selectExpr("student", "node", f"{_VALUE} as value")
    return cite.evaluate_requirements(leaves, nodes, asked.select("student", F.col("top").alias("node")))


add(
    "n7_requirements",
    _requirements,
    # of false, unknown and true as -1, 0 and 1, all_of is the least and any_of the largest; nodes are folded from the last number to the first
    f"""with recursive n as (select p_partkey as node, {BLOCK} as b, p_partkey % 20 as i, case when {_BELOW} then {_PARENT} end as parent from part where p_partkey < 200),
c as (select parent as node, list(node % 20) as l from n where parent is not null group by parent),
t as (select n.b, list(coalesce(l, []) order by i) as below from n left join c using (node) group by n.b),
f as (
  select c_custkey as student, c_nationkey as k, t.b, below, 20 as i, []::integer[] as v from customer join t on t.b = c_custkey % 10
  union all
  select student, k, b, below, i - 1, list_prepend(cast(case
    when len(below[i]) = 0 then case when node % 8 = 0 then 0 else coalesce(case when {_VALUE} then 1 else case when not ({_VALUE}) then -1 end end, 0) end
    when {_OP.format(p="node")} = 'all_of' then list_min(list_transform(below[i], lambda x: v[x - i + 1])) else list_max(list_transform(below[i], lambda x: v[x - i + 1])) end as integer), v)
  from (select *, b * 20 + i - 1 as node from f) where i > 0
)
select student, b * 20 as node, case v[1] when 1 then true when -1 then false end as value from f where i = 0""",
)
add(
    "n7_requirement_leaves",
    lambda s, d: cite.requirement_leaves(
        table(s, d, "customer").selectExpr("c_custkey as student"),
        s.createDataFrame([("a", "C1", None, None), ("b", "C2", 2.5, None), ("c", None, None, "C3"), ("d", None, None, None)], "node string, code string, min_grade double, equivalent string"),
        table(s, d, "customer").selectExpr("c_custkey as student", "'C' || (c_custkey % 3) as code", "case when c_custkey % 5 > 0 then c_custkey % 5 * 1.0D end as grade"),
        table(s, d, "customer").filter("c_custkey % 7 = 0").selectExpr("c_custkey as student", "'C3' as code"),
    ),
    "select c_custkey as student, unnest(['a', 'b', 'c', 'd']) as node, unnest([c_custkey % 3 = 1, case when c_custkey % 3 <> 2 then false when c_custkey % 5 > 0 then c_custkey % 5 >= 2.5 end, case when c_custkey % 7 = 0 then true end, null]) as value from customer",
)
add(
    "n8_requirement_minimums",
    lambda s, d: cite.requirement_minimums(
        plan(s, d).select("program", "category").distinct().withColumns({"least": F.lit(6000), "pages": F.array(F.lit(7), F.lit(9))}), plan(s, d).filter("not (program = 'P2' and category = 'R')").groupBy("program", "category").agg(F.sum("credits").alias("credits")), ["program", "category"]
    ),
    oracle(
        """, e as (select program, category, cast(sum(credits) as bigint) as credits from plan_item where not (program = 'P2' and category = 'R') group by all) select program, category, 6000 as least, [7, 9] as pages, credits, case when credits is null then 'unknown' when credits >= 6000 then 'met' else 'short' end as status from (select distinct program, category from plan_item) left join e using (program, category)"""
    ),
)

add(
    "n8_eligibility",
    lambda s, d: cite.eligibility(
        plan(s, d).select("program", "code").distinct(), roles.course(s, d).selectExpr("code", "credits", "explode(case when credits > 2 then array('A', 'B') else array('A') end) as source"),
        plan(s, d).select("program", "category").distinct().selectExpr("program", "case category when 'R' then 'free_elective' else category end as category", "cast(substring(program, 2) as int) * 3 as least", "array(4, cast(substring(program, 2) as int)) as pages"), ["program"],
    ),
    oracle(
        "select program, p.code, c.code is not null as found, case when credits > 2 then 'B' when c.code is not null then 'A' end as source, credits, cast(substring(program, 2) as int) * 3 as minimum, [4, cast(substring(program, 2) as int)] as pages, 'unknown' as status from (select distinct program, code from plan_item) p left join course c using (code)"
    ),
)

VARIANTS = "explode(array('of the', 'OF  the', 'the of', case when doc_id % 3 = 0 then 'the' else 'and' end)) as name"
add(
    "r8_vote_printed",
    lambda s, d: repair.vote_printed(table(s, d, "documents").selectExpr("doc_id", "'c' || doc_id as code", VARIANTS), table(s, d, "documents")).groupBy("doc_id", "name").agg(F.count("*").alias("n")),
    r""", t as (select doc_id, regexp_replace(lower(text), '\s+', '', 'g') as t from documents), v as (select doc_id, unnest(['ofthe', 'theof', 'and']) as k from documents where doc_id % 3 <> 0),
n as (select doc_id, k, (length(t) - length(replace(t, k, ''))) // length(k) as n from v join t using (doc_id)), m as (select doc_id, max(n) as m from n group by doc_id),
b as (select doc_id, min(k) as k from n join m using (doc_id) where n = m and n >= 2 group by doc_id having count(*) = 1), w as (select doc_id, unnest(['of the', 'OF  the', 'the of', case when doc_id % 3 = 0 then 'the' else 'and' end]) as name from documents)
select doc_id, coalesce(case k when 'ofthe' then 'OF  the' when 'theof' then 'the of' when 'and' then 'and' end, name) as name, count(*) as n from w left join b using (doc_id) group by all""".replace(", t as", "with t as", 1),
)
add(
    "r9_resolve_orphans",
    lambda s, d: repair.resolve_orphans(
        table(s, d, "part").selectExpr("p_partkey as id", "case p_partkey % 5 when 0 then p_name || p_partkey when 1 then upper(p_brand) || ' ' || p_partkey when 2 then 'Free choice' when 3 then 'Group choice ' || p_partkey else 'nothing' end as name"),
        table(s, d, "part").filter("p_partkey % 5 < 3").selectExpr("p_name || ' ' || p_partkey as name", "'I' || p_partkey as code"),
        table(s, d, "part").selectExpr("p_brand || p_partkey as name", "'K' || p_partkey % 2 as code").unionByName(table(s, d, "part").selectExpr("'Group  choice' || (p_partkey % 3 + 1) || '0000000' as name", "'0603xxx' || p_partkey % 2 as code")),
        {"free": "XXXXXXXX"},
    ).select("id", "code", "tier"),
    "select p_partkey as id, case p_partkey % 5 when 0 then 'I' || p_partkey when 1 then 'K' || p_partkey % 2 when 2 then 'XXXXXXXX' when 3 then '0603xxx0' end as code, case p_partkey % 5 when 0 then 'index' when 1 then 'known' when 2 then 'keyword' when 3 then 'series' end as tier from part",
)
add(
    "r10_recover_missing",
    lambda s, d: repair.recover_missing(
        table(s, d, "documents").selectExpr("doc_id", "doc_id as term", "text"),
        s.createDataFrame([("a", "MIT License"), ("b", "the MIT License"), ("c", "General Public License"), ("d", "short"), ("e", "Apache License")], "code string, name string").crossJoin(table(s, d, "documents").select("doc_id")),
        table(s, d, "documents").filter("doc_id % 2 = 0").selectExpr("doc_id", "doc_id as term", "'e' as code"),
    ),
    """with n as (select * from (values ('a', 'MIT License'), ('b', 'the MIT License'), ('c', 'General Public License'), ('e', 'Apache License')) v(code, name)), m as (select doc_id, doc_id as term, code, name from documents, n where contains(text, name))
select * from m where not (code = 'e' and term % 2 = 0) and not (code = 'a' and term in (select term from m where code = 'b'))""",
)
add(
    "r11_series_gaps",
    lambda s, d: repair.series_gaps(
        table(s, d, "part").filter("p_partkey % 5 <> 2 or p_partkey % 3 = 0").selectExpr("cast(floor(p_partkey / 10) as bigint) as k", "'s' as stem", "cast(p_partkey % 10 + 1 as int) as number", "3 as credits", "p_partkey - p_partkey % 5 as term"),
        table(s, d, "part").filter("p_partkey % 5 = 0").selectExpr("cast(floor(p_partkey / 10) as bigint) as k", "p_partkey as term", "cast(case when p_partkey % 7 < 3 then 3 else 1 end as int) as deficit"),
        ["k"],
    ),
    """with g as (select p_partkey as p, cast(floor(p_partkey / 10) as bigint) as k, cast(p_partkey % 10 + 1 as int) as number from part where p_partkey % 5 = 2 and p_partkey % 3 <> 0), s as (select g.*, (select min(q.p_partkey) from part q where cast(floor(q.p_partkey / 10) as bigint) = g.k and q.p_partkey > g.p and (q.p_partkey % 5 <> 2 or q.p_partkey % 3 = 0)) as sib from g),
t as (select cast(floor(p_partkey / 10) as bigint) as k, p_partkey as term from part where p_partkey % 5 = 0 and p_partkey % 7 < 3), n as (select k, count(*) as n, min(term) as sole from t group by k)
select k, 's' as stem, number, 3 as credits, coalesce(t.term, case when n = 1 then sole end) as term from s join n using (k) left join t on t.k = s.k and t.term = sib - sib % 5 where sib is not null and coalesce(t.term, case when n = 1 then sole end) is not null""".replace("select k, 's'", "select s.k, 's'"),
)
add(
    "r18_trim_glued",
    lambda s, d: repair.trim_glued(table(s, d, "part").selectExpr("p_partkey as code", "replace(p_name, ' ', '') || case p_partkey % 3 when 0 then ' and more of it' when 1 then ' short' else '' end as name"), table(s, d, "part").selectExpr("p_partkey as code", "p_name as name").union(table(s, d, "part").filter("p_partkey % 4 = 0").selectExpr("p_partkey as code", "p_name || ' other' as name"))),
    "select p_partkey as code, case when p_partkey % 3 = 0 and p_partkey % 4 > 0 then p_name else replace(p_name, ' ', '') || case p_partkey % 3 when 0 then ' and more of it' when 1 then ' short' else '' end end as name from part",
)
add(
    "r18_restore_spacing",
    lambda s, d: repair.restore_spacing(table(s, d, "part").selectExpr("p_partkey as code", "replace(p_name || p_partkey, ' ', '') as name"), table(s, d, "part").selectExpr("p_name || ' ' || p_partkey as name").union(table(s, d, "part").filter("p_partkey % 4 = 0").selectExpr("replace(p_name, ' ', '  ') || ' ' || p_partkey as name"))),
    "select p_partkey as code, case when p_partkey % 4 = 0 then replace(p_name || p_partkey, ' ', '') else p_name || ' ' || p_partkey end as name from part",
)
add(
    "r23_drop_recovered",
    lambda s, d: repair.drop_recovered(plan(s, d, "id % 3 = 0 as recovered").selectExpr("cast(floor(id / 4000) as bigint) as k", "ordinal", "category || type as code", "alt_group", "recovered"), ["k"]).select("ordinal", "alt_group"),
    oracle(
        """, r as (select cast(floor(id / 4000) as bigint) as k, id, category || type as code, alt_group, id % 3 = 0 as rec from plan_item), h as (select k, code, min(id) as heir from r where not rec group by all), g as (select r.k, r.code, min(alt_group) as grp from r join h using (k, code) where rec and alt_group is not null group by all)
select id as ordinal, case when not rec and alt_group is null and id = heir then grp else alt_group end as alt_group from r left join h using (k, code) left join g using (k, code) where not (rec and heir is not null)"""
    ),
)
add(
    "d5_terms_by_group",
    lambda s, d: repair.terms_by_group(plan(s, d).selectExpr("cast(floor(id / 1000) as bigint) as doc_id", "id as code", "case when id % 2 = 0 then 'Group ' || category else category end as grp"), plan(s, d).filter("id % 3 = 0").selectExpr("cast(floor(id / 1000) as bigint) as doc_id", "'group' || category as grp", "year || '/' || semester as term")),
    oracle(
        """, c as (select cast(floor(id / 1000) as bigint) as doc_id, id as code, category as c from plan_item), s as (select distinct cast(floor(id / 1000) as bigint) as doc_id, category as c, year || '/' || semester as term from plan_item where id % 3 = 0)
select c.doc_id, code, string_agg(distinct term, ', ' order by term) as terms from c join s on c.doc_id = s.doc_id and (c.c = s.c or (code % 2 = 1 and contains('group' || lower(s.c), lower(c.c)))) group by all"""
    ),
)
add(
    "r18_trim_to_printed",
    lambda s, d: repair.trim_to_printed(
        table(s, d, "part").selectExpr("p_partkey as code", "p_name || ' ' || p_brand || p_size as name"),
        table(s, d, "part").selectExpr("p_partkey as code", "p_name as name").union(table(s, d, "part").filter("p_partkey % 2 = 0").selectExpr("p_partkey as code", "p_name || ' ' || p_brand as name")),
    ),
    "select p_partkey as code, case when p_partkey % 2 = 0 then p_name || ' ' || p_brand else p_name end as name from part",
)
add(
    "r23_numbered_slots",
    lambda s, d: repair.group_numbered_slots(plan(s, d, "category || ' ' || (id % 2000)  as name").filter("alt_group is null").select("program", "edition", "track", "year", "semester", "id", "name", "alt_group"), ["program", "edition", "track", "year", "semester"]).select("id", "alt_group"),
    oracle(", p as (select *, min(category) over w <> max(category) over w as several from plan_item where alt_group is null window w as (partition by program, edition, track, year, semester, id % 2000)) select id, case when several then 'E' || (id % 2000) end as alt_group from p"),
)
add(
    "n1_match_mentions",
    lambda s, d: cite.match_mentions(table(s, d, "documents").selectExpr("doc_id as id", "text"), s.createDataFrame([("MIT License", "a"), ("License", "b"), ("the  MIT license", "c"), ("GNU General Public License", "d"), ("Apache License", "e"), ("apache license", "f")], "alias string, code string"))
    .groupBy("id", "alias", "code").agg(F.count("*").alias("n")),
    r"""with t as (select doc_id as id, ' ' || lower(regexp_replace(text, '\s+', ' ', 'g')) || ' ' as t from documents),
a as (select id, len(regexp_extract_all(t, '[^a-z0-9_]the mit license[^a-z0-9_]')) as c, len(regexp_extract_all(t, '[^a-z0-9_]mit license[^a-z0-9_]')) as m, len(regexp_extract_all(t, '[^a-z0-9_]gnu general public license[^a-z0-9_]')) as d, len(regexp_extract_all(t, '[^a-z0-9_]apache license[^a-z0-9_]')) as e, len(regexp_extract_all(t, '[^a-z0-9_]license[^a-z0-9_]')) as l from t),
r as (select id, 'the mit license' as alias, 'c' as code, c as n from a union all select id, 'mit license', 'a', m - c from a union all select id, 'gnu general public license', 'd', d from a union all select id, 'apache license', null, e from a union all select id, 'license', 'b', l - m - d - e from a) select id, alias, code, cast(n as bigint) as n from r where n > 0""",
)


def _before_after(s, d):
    before = roles.plan_item(s, d).select("id", "code", "credits", "alt_group", "pages")
    kept = before.filter("id % 7 > 0").selectExpr("id", "case when id % 3 = 0 then null else code end as code", "case when id % 5 = 0 then coalesce(credits, 0) + 1 else credits end as credits", "alt_group", "case when id % 11 = 0 then array(0) else pages end as pages")
    return before, kept.unionByName(before.filter("id % 13 = 0").selectExpr("-id as id", "code", "cast(null as int) as credits", "alt_group", "pages"))


add(
    "repair_log",
    lambda s, d: changes.repair_log(*_before_after(s, d), ["id"], "made"),
    oracle(
        """, p as (select id, code, credits, alt_group, case when pages is not null then '[' || array_to_string(pages, ',') || ']' end as pages from plan_item), k as (select * from p where id % 7 > 0), a as (select * from p where id % 13 = 0)
select *, 'made' as rule from (
  select id, 'dropped' as kind, null as field, null as old, null as new from p where id % 7 = 0
  union all select id, 'changed', 'code', code, null from k where id % 3 = 0 and code is not null
  union all select id, 'changed', 'credits', '' || credits, '' || (coalesce(credits, 0) + 1) from k where id % 5 = 0
  union all select id, 'changed', 'pages', pages, '[0]' from k where id % 11 = 0 and pages is distinct from '[0]'
  union all select -id, 'added', null, null, null from a union all select -id, 'added', 'code', null, code from a where code is not null
  union all select -id, 'added', 'alt_group', null, alt_group from a where alt_group is not null union all select -id, 'added', 'pages', null, pages from a where pages is not null)"""
    ),
)
add(
    "repair_log_applied",
    lambda s, d: (lambda b, a: changes.apply_log(b, changes.repair_log(b, a, ["id"], "made"), ["id"]))(*_before_after(s, d)).select("id", "code", "credits", "alt_group", F.to_json("pages").alias("pages")),
    oracle(
        """, p as (select id, code, credits, alt_group, case when pages is not null then '[' || array_to_string(pages, ',') || ']' end as pages from plan_item)
select id, case when id % 3 > 0 then code end as code, case when id % 5 = 0 then cast(coalesce(credits, 0) + 1 as int) else credits end as credits, alt_group, case when id % 11 = 0 then '[0]' else pages end as pages from p where id % 7 > 0
union all select -id, code, null, alt_group, pages from p where id % 13 = 0"""
    ),
)
