"""Queries over views, the query surface, checks and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantables.operators import checks, graph, query, views
from plantables.plans.registry import add
from plantables.sources import roles
from plantables.sources.roles import SCOPE, oracle

S = "program, edition, track"
T = f"{S}, year, semester"
V3 = f""", v3 as (select {T}, cast(sum(credits) as bigint) as credits, count(*) as n_courses from (select {T}, coalesce(alt_group, 'x' || id) as g, min(credits) as credits from plan_item group by all) group by {T})"""
REAL = "regexp_full_match(code, '[0-9]{8}')"


def _plan(s, d):
    return roles.plan_item(s, d)


def _course(s, d):
    return roles.course(s, d)


def _pre(s, d):
    return roles.prerequisite(s, d)


add("v1_plan", lambda s, d: views.plan_view(_plan(s, d), _course(s, d)), oracle("select p.* exclude (pages), c.name_th, c.name_en, coalesce(p.pages, c.pages) as pages from plan_item p left join course c using (code)"))
add(
    "v2_course_terms",
    lambda s, d: views.course_terms(_plan(s, d), roles.elective_slot(s, d), _course(s, d)),
    oracle(
        f"select {T}, code, name_th, coalesce(p.credits, c.credits) as credits, allowed_terms from (select {T}, code, credits, null::varchar as allowed_terms from plan_item union all select {S}, null::int, null::int, code, credits, allowed_terms from elective_slot) p left join (select code, name_th, credits from course) c using (code)"
    ),
)
add("v3_semester_credits", lambda s, d: views.semester_credits(_plan(s, d)), oracle(f"{V3} select * from v3"))
add("v4_year_credits", lambda s, d: views.year_credits(_plan(s, d)), oracle(f"{V3} select {S}, year, cast(sum(credits) as bigint) as credits from v3 group by all"))
add(
    "v5_category_credits",
    lambda s, d: views.category_credits(_plan(s, d)),
    oracle(f"select {S}, category, type, cast(sum(credits) as bigint) as credits from (select {T}, category, type, coalesce(alt_group, 'x' || id) as g, min(credits) as credits from plan_item group by all) group by all"),
)
add(
    "v6_prereq",
    lambda s, d: views.prerequisite_view(_pre(s, d), _course(s, d)),
    oracle("select e.code, a.name_th as name, requires, b.name_th as requires_name, kind from prerequisite e left join course a on a.code = e.code left join course b on b.code = e.requires"),
)
add(
    "v7_unlocks",
    lambda s, d: views.unlocks_view(_pre(s, d), _course(s, d)),
    oracle("select e.requires as code, b.name_th as name, e.code as unlocks, a.name_th as unlocks_name, kind from prerequisite e left join course a on a.code = e.code left join course b on b.code = e.requires"),
)
add("v8_real_courses", lambda s, d: views.real_courses(_course(s, d)), oracle(f"select * from course where {REAL}"))
add(
    "v9_prereq_stats",
    lambda s, d: views.prerequisite_stats(_course(s, d), _pre(s, d)),
    oracle("select code, (select count(distinct requires) from prerequisite e where e.code = c.code and kind = 'pre') as n_requires, (select count(distinct e.code) from prerequisite e where e.requires = c.code and kind = 'pre') as n_unlocks from course c"),
)
add("v10_qa_course", lambda s, d: views.qa_course(_course(s, d)), oracle(f"select code, name_th, name_en, credits, lecture_h, lab_h, self_h, pages as course_pages from course where {REAL}"))
add(
    "v10_qa_plan",
    lambda s, d: views.qa_plan(_plan(s, d), _course(s, d)),
    oracle(
        f"select distinct {T}, code, name_th, name_en, coalesce(p.credits, c.credits) as credits, lecture_h, lab_h, self_h, category, type, alt_group, c.pages as course_pages, p.pages as plan_pages from plan_item p left join course c using (code) where {REAL}"
    ),
)
add(
    "v10_qa_program",
    lambda s, d: views.qa_program(roles.table(s, d, "supplier").selectExpr("s_suppkey as program_id", "s_name as name_th", "s_name as name_en", "'D' || s_nationkey as degree", "s_nationkey * 10 as total_credits", "s_nationkey % 8 + 1 as years", "s_acctbal")),
    "select s_suppkey as program_id, s_name as name_th, s_name as name_en, 'D' || s_nationkey as degree, s_nationkey * 10 as total_credits, s_nationkey % 8 + 1 as years from supplier",
)
SLOT_CODE = "case when code like '%4' then 'S' || right(code, 7) else code end as code"
SLOT_MORE = "case when credits > 3 then 'slot' else '' end as type", "'slot ' || category as name_th"
add(
    "v11_flatten_prediction",
    lambda s, d: views.flatten_prediction(_course(s, d), _plan(s, d).selectExpr("* except (category)", "case when id % 3 > 0 then category else '' end as category"), _pre(s, d), roles.elective_slot(s, d).selectExpr("* except (code)", SLOT_CODE, *SLOT_MORE)),
    oracle(
        f""", p as (select *, case when id % 3 > 0 then category end as cat from plan_item),
f as (select {S}, code, min({{'y': year, 's': semester, 'i': id}}) as k, arg_min(cat, {{'y': year, 's': semester, 'i': id}}) filter (cat is not null) as cat, arg_min(type, {{'y': year, 's': semester, 'i': id}}) filter (type <> '') as typ from p group by all),
l as (select {S}, {SLOT_CODE}, category as lc, case when credits > 3 then 'slot' end as lt, 'slot ' || category as ln, allowed_terms from elective_slot),
n as (select code, array_to_string(list_sort(list_distinct(list(requires))), ', ') as prerequisite from prerequisite group by code),
c as (select code, name_th, coalesce(credits || '(' || lecture_h || '-' || lab_h || '-' || self_h || ')', '' || credits) as credits from course)
select {S}, code, coalesce(k.y, 0) as year, coalesce(k.s, 0) as semester, coalesce(cat, lc) as category, coalesce(typ, lt) as type, coalesce(name_th, ln) as name_th, credits, allowed_terms, coalesce(prerequisite, '') as prerequisite
from f full join l using ({S}, code) full join c using (code) left join n using (code)"""
    ),
)
CUT = "trim(regexp_replace(regexp_replace({}, '^(?:small|large|red)\\s*', ''), '\\s*(?:bolt|Brand#1|Brand#2)$', ''))"
add(
    "v12_lexicon",
    lambda s, d: views.lexicon(_course(s, d), r"^(?:small|large|red)\s*", r"\s*(?:bolt|Brand#1|Brand#2)$"),
    oracle(
        f""", n as (select code, trim(unnest([name_th, name_en])) as name from course), a as (select *, {CUT.format('name')} as x from n where length(name) >= 3), b as (select *, case when length(x) >= 6 then x end as once from a),
e as (select *, {CUT.format('once')} as y from b), f as (select code, name as alias from e union select code, once from e union select code, y from e where length(y) >= 6)
select alias, count(*) as n_codes, min(code) as first_code, list_sort(list(code)) as codes from f where alias is not null group by alias"""
    ),
)
add(
    "v12_vocabulary",
    lambda s, d: views.vocabulary(_plan(s, d).selectExpr("case category when 'R' then 'free ' || year when 'A' then 'General ' || semester when 'N' then category end as category", "type || case when semester = 1 then ' ' else '' end as type"), {"required": ["F"], "elective": ["O"]}),
    oracle(
        "select distinct 'category' as field, case category when 'R' then 'free_elective' when 'A' then 'general_education' else 'specialized' end as kind, case category when 'R' then 'free ' || year when 'A' then 'General ' || semester else category end as value from plan_item union all select distinct 'type', case type when 'F' then 'required' else 'elective' end, type || case when semester = 1 then ' ' else '' end from plan_item"
    ),
)

add(
    "q1_predicates",
    lambda s, d: _course(s, d).filter((F.col("credits").between(2, 8) & ~F.col("lab_h").isin(0) & (F.col("lecture_h") <= 2)) | F.col("credits").isNull() | (F.col("self_h") != 3) & ~(F.col("credits") > 4)).select("code", "credits"),
    oracle("select code, credits from course where (credits between 2 and 8 and lab_h not in (0) and lecture_h <= 2) or credits is null or (self_h <> 3 and not (credits > 4))"),
)
add("q2_like", lambda s, d: _course(s, d).filter(F.col("name_en").ilike("%BRAND#1%") & ~F.col("name_th").ilike("%RED%")).select("code", "name_en"), oracle("select code, name_en from course where name_en ilike '%BRAND#1%' and not name_th ilike '%RED%'"))
add(
    "q3_search_courses",
    lambda s, d: query.search_courses(_course(s, d), "Brand#2", 25, 5).select("code", "name_th", "name_en"),
    oracle("select code, name_th, name_en from course where code ilike '%brand#2%' or name_th ilike '%brand#2%' or name_en ilike '%brand#2%' order by code limit 25 offset 5"),
)
add(
    "q4_term_plan",
    lambda s, d: query.term_plan(views.plan_view(_plan(s, d), _course(s, d)), 2, 1).select(*SCOPE, "id", "code", "name_th", "credits"),
    oracle(f"select {S}, id, code, name_th, p.credits from plan_item p left join course c using (code) where year = 2 and semester = 1"),
)
add("q5_lookup", lambda s, d: _course(s, d).filter(F.col("code") == "00000123").select("code", "name_th", "credits", "lecture_h", "pages"), oracle("select code, name_th, credits, lecture_h, pages from course where code = '00000123'"))
add("q6_count_courses", lambda s, d: _plan(s, d).groupBy("category", "year").agg(F.count_distinct("code").alias("n")), oracle("select category, year, count(distinct code) as n from plan_item group by all"))
add(
    "q7_partial_totals",
    lambda s, d: query.partial_total(_course(s, d).withColumn("first", F.substring("code", 7, 1)), "credits", ["first"]),
    oracle("select substring(code, 7, 1) as first, cast(sum(credits) as bigint) as total, avg(credits) as mean, min(credits) as least, max(credits) as most, cast(count_if(credits is null) as bigint) as n_unknown from course group by first"),
)
add(
    "q8_extremum",
    lambda s, d: views.semester_credits(_plan(s, d)).groupBy(*SCOPE).agg(F.max("credits").alias("most"), F.min("credits").alias("least"), F.count_if(F.col("credits") > 20).alias("n_above")),
    oracle(f"{V3} select {S}, max(credits) as most, min(credits) as least, cast(count_if(credits > 20) as bigint) as n_above from v3 group by all"),
)
add(
    "q9_top",
    lambda s, d: query.top(_pre(s, d).groupBy("requires").agg(F.count("*").alias("n")), "n", ["requires"], 10),
    oracle("select requires, count(*) as n from prerequisite group by requires order by n desc, requires limit 10"),
)
add(
    "q9_top_with_ties",
    lambda s, d: query.top(views.semester_credits(_plan(s, d)), "credits", ["year", "semester"], 1, by=SCOPE, with_ties=True),
    oracle(f"{V3} select * exclude (r) from (select *, rank() over (partition by {S} order by credits desc) as r from v3) where r <= 1"),
)
add("q10_in_subquery", lambda s, d: _course(s, d).join(_pre(s, d), "code", "left_semi").select("code", "name_th"), oracle("select code, name_th from course where code in (select code from prerequisite)"))
add(
    "q11_not_in",
    lambda s, d: query.not_in(_course(s, d), "code", _pre(s, d), "requires").select("code"),
    oracle("select code from course where code not in (select requires from prerequisite)"),
)
add(
    "q11_not_in_with_null",
    lambda s, d: query.not_in(_course(s, d), "code", _pre(s, d).select(F.when(F.col("kind") == "pre", F.col("requires")).alias("requires")), "requires").select("code"),
    oracle("select code from course where code not in (select case when kind = 'pre' then requires end from prerequisite)"),
)
add("q12_slots_open", lambda s, d: query.slots_open_in(roles.elective_slot(s, d), "2/3").select(*SCOPE, "code", "allowed_terms"), oracle(f"select {S}, code, allowed_terms from elective_slot where list_contains(string_split(allowed_terms, ', '), '2/3')"))
add(
    "q13_stable_sort",
    lambda s, d: _course(s, d).orderBy(F.col("credits").asc_nulls_first(), "code").select("code", "credits"),
    oracle("select code, credits from course order by credits nulls first, code"),
)
add(
    "q14_page_result",
    lambda s, d: query.page_result(_plan(s, d).select(*SCOPE, "id", "code"), SCOPE, ["code", "id"], 2, 10),
    oracle(f"select {S}, id, code, n as total_count, n > 20 as has_more from (select {S}, id, code, count(*) over (partition by {S}) as n, row_number() over (partition by {S} order by code, id) as r from plan_item) where r > 10 and r <= 20"),
)
add(
    "q15_search_relaxed",
    lambda s, d: query.search_relaxed(_course(s, d), "Brand#12x").select("code", "name_en", "tier"),
    oracle("select code, name_en, 1 as tier from course where name_en ilike '%Brand#12%' and not exists (select 1 from course where name_en ilike '%Brand#12x%')"),
)
add(
    "q16_single_column_answer",
    lambda s, d: query.single_column_answer(_plan(s, d).filter("year = 1 and semester = 2"), SCOPE, "category", "id"),
    oracle(f"select {S}, string_agg(category, ', ' order by a, category) as answer from (select {S}, category, min(id) as a from plan_item where year = 1 and semester = 2 group by all) group by {S}"),
)
add(
    "q17_code_tally",
    lambda s, d: query.code_tally(_plan(s, d), SCOPE),
    oracle(f"select {S}, count(*) as n_rows, count(distinct case when {REAL} then code end) as n_real, cast(count_if(starts_with(code, 'PLACEHOLDER_')) as bigint) as n_placeholder, cast(count_if(not {REAL} and not starts_with(code, 'PLACEHOLDER_')) as bigint) as n_invalid from plan_item group by {S}"),
)
add(
    "q18_list_catalog",
    lambda s, d: query.list_catalog(_plan(s, d), s.createDataFrame([("P1", 1), ("P2", 0)], "program string, edition int")),
    oracle(", t as (select program, edition, string_agg(distinct cast(track as varchar), ',' order by cast(track as varchar)) as tracks from plan_item group by all) select program, string_agg(edition || ':' || tracks, ';' order by edition) as editions, case when program = 'P1' then 1 else min(edition) end as default_edition from t group by program"),
)
SIDES = ", s as (select {by}, code, bool_or({over} = {a}) as a, bool_or({over} = {b}) as b from plan_item where regexp_full_match(code, '[0-9]{{8}}') and {over} in ({a}, {b}) group by all) select {by}, code, case when a and b then 'common' when a then 'first_only' else 'second_only' end as side from s"
add("e1_compare_editions", lambda s, d: query.compare(_plan(s, d), "edition", 0, 1, ["program", "track"]), oracle(SIDES.format(by="program, track", over="edition", a=0, b=1)))
add("e2_compare_tracks", lambda s, d: query.compare(_plan(s, d), "track", 0, 1, ["program", "edition"]), oracle(SIDES.format(by="program, edition", over="track", a=0, b=1)))
add(
    "e2_compare_counts",
    lambda s, d: query.compare_counts(_plan(s, d).withColumn("code", F.expr("case when id % 50 = 0 then right(code, 6) else code end")), "track", 0, 1, ["program", "edition"]),
    oracle(
        """, p as (select program, edition, track, case when id % 50 = 0 then right(code, 6) else code end as code from plan_item), q as (select *, regexp_full_match(code, '[0-9]{8}') as real, starts_with(code, 'PLACEHOLDER_') as held from p),
s as (select program, edition, code, bool_or(track = 0) as a, bool_or(track = 1) as b from q where real group by all), n as (select program, edition, cast(count_if(a and b) as bigint) as n_common, cast(count_if(a and not b) as bigint) as n_first_only, cast(count_if(b and not a) as bigint) as n_second_only from s group by all)
select program, edition, n_common, n_first_only, n_second_only, cast(count_if(track = 0) as bigint) as first_rows, cast(count_if(track = 0 and held) as bigint) as first_placeholder, cast(count_if(track = 0 and not held and not real) as bigint) as first_invalid, cast(count_if(track = 1) as bigint) as second_rows, cast(count_if(track = 1 and held) as bigint) as second_placeholder, cast(count_if(track = 1 and not held and not real) as bigint) as second_invalid from q join n using (program, edition) group by all"""
    ),
)
add(
    "e3_union",
    lambda s, d: _plan(s, d).select("code").union(roles.elective_slot(s, d).select("code")).union(_pre(s, d).select(F.col("requires").alias("code"))).distinct(),
    oracle("select code from plan_item union select code from elective_slot union select requires from prerequisite"),
)
add(
    "e4_resolve_edition",
    lambda s, d: query.resolve_edition(
        _plan(s, d).select("program", F.col("year").alias("year_label")).distinct().union(_plan(s, d).select("program", F.lit(9)).distinct()), _plan(s, d).select("program", F.col("year").alias("year_label"), "edition").distinct()
    ),
    oracle(
        ", e as (select program, year as year_label, count(distinct edition) as n, min(edition) as m from plan_item group by all) select program, year_label, case when n = 1 then m end as edition, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'found' end as status from (select distinct program, year as year_label from plan_item union all select distinct program, 9 from plan_item) left join e using (program, year_label)"
    ),
)

add(
    "c1_total_credits",
    lambda s, d: checks.total_credits(
        _plan(s, d),
        views.semester_credits(_plan(s, d)).groupBy(*SCOPE).agg((F.sum("credits") + F.col("edition")).alias("total_credits")).unionByName(s.createDataFrame([("P9", 0, 0, 0), ("P9", 0, 1, 3)], "program string, edition int, track int, total_credits long")),
        roles.elective_slot(s, d).withColumn("counted", F.expr("track = 1 and code = '00000013'")),
    ),
    oracle(
        f"""{V3}, c as (select {S}, cast(sum(credits) as bigint) as planned from v3 group by all), x as (select {S}, cast(sum(credits) as bigint) as counted from elective_slot where track = 1 and code = '00000013' group by all)
select {S}, planned + edition as total_credits, planned + coalesce(counted, 0) as computed, edition = coalesce(counted, 0) as ok from c left join x using ({S}) union all select 'P9', 0, 0, 0, 0, true union all select 'P9', 0, 1, 3, 0, false"""
    ),
)
add("c2_orphans", lambda s, d: checks.orphans(_plan(s, d), _course(s, d)), oracle(f"select distinct {S}, code from plan_item where code not in (select code from course)"))
add(
    "c3_bad_codes",
    lambda s, d: checks.bad_codes(_plan(s, d).withColumn("code", F.when(F.col("id") % 7 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code"))), _course(s, d)),
    oracle(f"select code from (select case when id % 7 = 0 then code || 'x' else code end as code from plan_item union select code from course) where not {REAL} and not starts_with(code, 'PLACEHOLDER_')"),
)
add("c4_credit_mismatch", lambda s, d: checks.credit_mismatch(_plan(s, d), _course(s, d)), oracle(f"select {S}, id, code, p.credits, c.credits as course_credits from plan_item p join course c using (code) where p.credits <> c.credits"))
add(
    "c5_prerequisite_order",
    lambda s, d: checks.prerequisite_order(_plan(s, d), _pre(s, d)),
    oracle(f", t as materialized (select distinct {S}, code, year * 10 + semester as at from plan_item), e as materialized (select distinct code, requires from prerequisite where kind = 'pre' and code <> requires) select a.program, a.edition, a.track, a.code, requires, a.at, b.at as requires_at from t a join e on e.code = a.code join t b on b.code = requires and (a.program, a.edition, a.track) = (b.program, b.edition, b.track) where b.at >= a.at"),
)
add("c6_duplicates", lambda s, d: checks.duplicates_in_term(_plan(s, d)), oracle(f"select {T}, code, count(*) as n from plan_item where alt_group is null group by all having count(*) > 1"))
add(
    "c7_term_load",
    lambda s, d: checks.term_load(_plan(s, d).filter("credits < 6 or (year = 2 and edition = 1)").withColumns({"note": F.expr("case when program = 'P1' and year = 1 then 'Internship' end"), "name_en": F.expr("case when program = 'P2' then 'Coop ' || code end")}), 9, 300),
    oracle(f", p as (select * from plan_item where credits < 6 or (year = 2 and edition = 1)), v as (select {T}, cast(sum(credits) as bigint) as credits from (select {T}, coalesce(alt_group, 'x' || id) as g, min(credits) as credits from p group by all) group by {T}) select * from v where semester <> 3 and not credits between 9 and 300 and ({T}) not in (select ({T}) from p where credits >= 6 or (program = 'P1' and year = 1) or program = 'P2')"),
)
ROW_RULES = {
    "code": "case id % 9 when 0 then right(code, 7) when 1 then code || ' or 0603xxxx' when 2 then '' else right('0000' || code, 8) end",
    "credits": "case id % 7 when 0 then 'abc' when 1 then '3(3-0-6) or 4' when 2 then null else '3 (3-0-6)' end",
    "flexible": "case when id % 11 = 0 then '3/1' end",
    "name_th": "case when id % 13 = 0 then 'Latin' else 'name' end",
    "name_en": "case when id % 17 = 0 then 'x 3(3-0-6)' end",
    "prerequisite": "case when id % 19 = 0 then '00000001' when id % 19 = 1 then right('0000' || code, 8) end",
    "k": "cast(floor(id / 2000) as bigint)",
    "y": "cast(case when id % 5 = 0 then 0 when id % 2000 < 1000 then 0 else year end as int)",
}
RULE_ROWS = "select id, " + ", ".join(f"{e} as {n}" for n, e in ROW_RULES.items()) + ", category, type from plan_item where code like '0%'"
add(
    "c8_row_rules",
    lambda s, d: checks.row_rules(_plan(s, d).filter("code like '0%'").selectExpr("id as ordinal", *(f"{e} as {n}" for n, e in ROW_RULES.items()), "category", "type").selectExpr("* except (y)", "y as year", "y as semester"), ["k"], ["A", "N"], ["O"]),
    oracle(
        f""", r as ({RULE_ROWS}), h as (select distinct k, unnest(string_split(code, ' or ')) as c from r), d as (select distinct k from r where y > 0), q as (select *, k in (select k from d) as dated from r)
select id as ordinal, unnest(list_filter([case when id % 9 in (0, 2) then 'code' end, case when id % 7 = 0 then 'credits' end, case when category = 'R' then 'category' end, case when type = 'F' then 'type' end, case when y = 0 and flexible is null and dated then 'flexible' end, case when y > 0 and flexible is not null then 'fixed' end, case when id % 13 = 0 then 'name' end, case when id % 17 = 0 then 'credits in name' end, case when prerequisite is not null and (k, prerequisite) not in (select (k, c) from h) then 'prerequisite' end], lambda x: x is not null)) as rule from q"""
    ),
)
add(
    "c9_term_bounds",
    lambda s, d: checks.term_bounds(_plan(s, d), 400, 600),
    oracle(f", g as (select {T}, coalesce(alt_group, 'x' || id) as g, max(credits) as credits from plan_item group by all), t as (select {T}, cast(sum(credits) as bigint) as credits, max(credits) as m from g group by {T}) select * exclude (m), case when credits > 600 then 'above' else 'below' end as fault from t where credits > 600 or (credits < 400 and m < 6)"),
)
add("c10_duplicate_keys", lambda s, d: checks.duplicate_keys(_plan(s, d), ["code", "year", "semester", "category"]), oracle("select code, year, semester, category, count(*) as n from plan_item group by all having count(*) > 1"))
add(
    "c11_report",
    lambda s, d: checks.report(
        {
            "CHK2": checks.orphans(_plan(s, d), _course(s, d)).withColumn("example", F.col("code")),
            "CHK6": checks.duplicates_in_term(_plan(s, d)).withColumn("example", F.concat_ws("/", "year", "semester", "code")),
            "CHK9": checks.term_bounds(_plan(s, d), 0, 100_000).withColumn("example", F.col("fault")),
        },
        _plan(s, d),
    ),
    oracle(
        f""", g as (select {T}, coalesce(alt_group, 'x' || id) as g, max(credits) as credits from plan_item group by all), t as (select {T}, cast(sum(credits) as bigint) as credits, max(credits) as m from g group by {T}),
f as (select distinct {S}, 'CHK2' as "check", code as example from plan_item where code not in (select code from course) union all select {S}, 'CHK6', year || '/' || semester || '/' || code from plan_item where alt_group is null group by {T}, code having count(*) > 1
union all select {S}, 'CHK9', case when credits > 100000 then 'above' else 'below' end from t where credits > 100000 or credits < 0 and m < 6),
k as (select distinct {S}, c as "check" from plan_item, (values ('CHK2'), ('CHK6'), ('CHK9')) v(c))
select {S}, "check", count(example) = 0 as ok, count(example) as n, coalesce(array_to_string(list_sort(list(example) filter (example is not null))[1:5], '; '), '') as detail from k left join f using ({S}, "check") group by all"""
    ),
)
#: Rows of the plan whose code is spoilt.
SPOILT = "case when id % 97 = 0 then code || 'x' else code end"


def _every_check(s, d):
    plan = _plan(s, d).withColumn("code", F.expr(SPOILT))
    program = views.semester_credits(plan).filter("program <> 'P4'").groupBy(*SCOPE).agg((F.sum("credits") + F.col("edition")).alias("total_credits"))
    return checks.report(checks.every_check(plan, _course(s, d), program, load=(400, 600), bounds=(400, 600)), plan)


add(
    "c11_every_check",
    _every_check,
    oracle(
        f"""{V3}, p as (select * replace ({SPOILT} as code) from plan_item), c as (select {S}, cast(sum(credits) as bigint) as planned from v3 group by all),
g as (select {T}, coalesce(alt_group, 'x' || id) as g, max(credits) as credits from p group by all), t as (select {T}, cast(sum(credits) as bigint) as credits, max(credits) as m from g group by {T}), y as (select {S}, unnest(range(1, max(year) + 1)) :: int as year from p group by {S}),
f as (select distinct {S}, 'CHK0' as "check", program as example from p where program = 'P4'
union all select {S}, 'CHK1', (planned + edition) || '/' || planned from c where edition <> 0 and program <> 'P4'
union all select distinct {S}, 'CHK2', code from p where code not in (select code from course)
union all select distinct {S}, 'CHK3', code from p where not {REAL} and not starts_with(code, 'PLACEHOLDER_')
union all select {S}, 'CHK4', id || '/' || p.credits || '/' || course.credits from p join course using (code) where p.credits <> course.credits
union all select {S}, 'CHK6', year || '/' || semester || '/' || code from p where alt_group is null group by {T}, code having count(*) > 1
union all select {S}, 'CHK7', year || '/' || semester || '/' || credits from v3 where semester <> 3 and not credits between 400 and 600 and ({T}) not in (select ({T}) from p where credits >= 6)
union all select {S}, 'CHK9', year || '/' || semester || '/' || case when credits > 600 then 'above' else 'below' end from t where credits > 600 or credits < 400 and m < 6
union all select {S}, 'CHK13', year || '/' || s from y, (values (1), (2)) v(s) where ({S}, year, s) not in (select ({T}) from p)),
k as (select distinct {S}, c as "check" from p, (values ('CHK0'), ('CHK1'), ('CHK2'), ('CHK3'), ('CHK4'), ('CHK6'), ('CHK7'), ('CHK9'), ('CHK13')) v(c))
select {S}, "check", count(example) = 0 as ok, count(example) as n, coalesce(array_to_string(list_sort(list(example) filter (example is not null))[1:5], '; '), '') as detail from k left join f using ({S}, "check") group by all"""
    ),
)
add(
    "c12_student_plans",
    lambda s, d: checks.student_plans(
        roles.table(s, d, "orders").join(roles.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_custkey as student", "cast(o_orderkey % 8 as int) as term", "lpad('' || l_partkey, 8, '0') as code", "cast(cast(l_quantity as bigint) % 7 as int) as credits"),
        _course(s, d),
        _pre(s, d),
    ),
    oracle(
        """, l as (select o_custkey as student, cast(o_orderkey % 8 as int) as term, lpad('' || l_partkey, 8, '0') as code, cast(cast(l_quantity as bigint) % 7 as int) as credits from orders join lineitem on o_orderkey = l_orderkey),
a as (select student, code, min(term) as at from l group by all)
select distinct student, code, 'unknown' as fault from l where code not in (select code from course) union all
select student, code, 'repeated' from l group by student, code having count(*) > 1 union all
select student, '' || term, 'cap' from l group by student, term having sum(credits) > 22 union all
select distinct a.student, a.code, 'order' from a join prerequisite e on e.code = a.code and kind = 'pre' and e.code <> requires left join a b on b.student = a.student and b.code = requires where b.at is null or b.at >= a.at"""
    ),
)
add(
    # each order is a list; what a student has from orders of low priority is the record, and every course that a fifth divides is approved
    "c12_with_record",
    lambda s, d: (
        lambda l, done: checks.student_plans(l.filter("not done"), _course(s, d), _pre(s, d), 30, l.filter("done").select("student", "code"), roles.table(s, d, "orders").selectExpr("o_custkey as student", "lpad('' || (o_custkey % 200 * 5), 8, '0') as code"))
    )(*[roles.table(s, d, "orders").join(roles.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_custkey as student", "o_orderkey as entry", "cast(o_orderkey % 8 as int) as term", "lpad('' || l_partkey, 8, '0') as code", "cast(cast(l_quantity as bigint) % 7 as int) as credits", "o_orderpriority like '5%' as done")] * 2),
    oracle(
        """, x as materialized (select o_custkey as student, o_orderkey as entry, cast(o_orderkey % 8 as int) as term, lpad('' || l_partkey, 8, '0') as code, cast(cast(l_quantity as bigint) % 7 as int) as credits, o_orderpriority like '5%' as done from orders join lineitem on o_orderkey = l_orderkey),
l as (select * from x where not done), a as materialized (select student, code, min(term) as at from l group by all),
r as materialized (select student, code from x where done union select o_custkey, lpad('' || (o_custkey % 200 * 5), 8, '0') from orders)
select distinct student, code, 'unknown' as fault from l where code not in (select code from course) union all
select student, code, 'repeated' from l group by student, code having count(*) > 1 union all
select student, '' || term, case when count(distinct entry) > 1 then 'duplicate term' else 'cap' end from l group by student, term having count(distinct entry) > 1 or sum(credits) > 30 union all
select distinct a.student, a.code, 'order' from a join prerequisite e on e.code = a.code and kind = 'pre' and e.code <> requires left join a b on b.student = a.student and b.code = requires left join r on r.student = a.student and r.code = requires where r.code is null and (b.at is null or b.at >= a.at)"""
    ),
)
add(
    "c13_missing_terms",
    lambda s, d: checks.missing_terms(_plan(s, d).filter("not (year = 2 and semester = edition + 1)")),
    oracle(f", p as (select * from plan_item where not (year = 2 and semester = edition + 1)), y as (select {S}, unnest(range(1, max(year) + 1))::int as year from p group by {S}) select {S}, year, s::int as semester from y, (values (1), (2)) v(s) where ({S}, year, s) not in (select ({T}) from p)"),
)
RANGES = "select program, edition, cast(min(page) as int) as first, cast(min(page) + {n} as int) as last from plan_item where page is not null and track = {t} group by program, edition, year"
add(
    "c14_ranges_differ",
    lambda s, d: checks.ranges_differ(
        *(_plan(s, d).filter(f"pages is not null and track = {t}").groupBy("program", "edition", "year").agg(F.min(F.element_at("pages", 1)).alias("first"), (F.min(F.element_at("pages", 1)) + n).alias("last")) for t, n in ((0, 4), (1, 6))), ["program", "edition"]
    ),
    oracle(
        ", l as (select distinct program, edition, unnest(range(f, f + 5)) as page from (select program, edition, year, min(pages[1]) as f from plan_item where pages is not null and track = 0 group by all)), r as (select distinct program, edition, unnest(range(f, f + 7)) as page from (select program, edition, year, min(pages[1]) as f from plan_item where pages is not null and track = 1 group by all)) select program, edition, cast(page as int) as page, case when l.page is not null then 'first_only' else 'second_only' end as side from (select *, 1 as i from l) l full join (select *, 1 as j from r) r using (program, edition, page) where i is null or j is null".replace(
            "case when l.page is not null", "case when i is not null"
        )
    ),
)

CODES = ["00000013", "00000077", "00000124"]
LIST = "('00000013', '00000077', '00000124')"
add("g1_prerequisites", lambda s, d: graph.neighbours(_pre(s, d), CODES, "pre"), oracle(f"select distinct code, requires as other from prerequisite where code in {LIST} and kind = 'pre'"))
add("g1_unlocked_by", lambda s, d: graph.neighbours(_pre(s, d), CODES, "pre", back=True), oracle(f"select distinct requires as code, code as other from prerequisite where requires in {LIST} and kind = 'pre'"))


def _seeds(s, d):
    return _course(s, d).select("code")


add(
    "g2_closure",
    lambda s, d: graph.closure(_pre(s, d).withColumn("kind", F.lit("pre")), _seeds(s, d)),
    oracle(", c as (select code as seed, requires as code from prerequisite where code in (select code from course) union select c.seed, e.requires from c join prerequisite e on e.code = c.code) select seed, code from c"),
)
add(
    "g2_closure_cyclic",
    lambda s, d: graph.closure(roles.cyclic_prerequisite(s, d), s.createDataFrame([("00000007",), ("00000123",), ("00000555",)], "code string")),
    oracle(", c as (select code as seed, requires as code from cyclic_prerequisite where code in ('00000007', '00000123', '00000555') union select c.seed, e.requires from c join cyclic_prerequisite e on e.code = c.code) select seed, code from c"),
)
add(
    "g3_dependents",
    lambda s, d: graph.closure(_pre(s, d).withColumn("kind", F.lit("pre")), s.createDataFrame([("00000012",), ("00000123",)], "code string"), back=True).join(_plan(s, d).groupBy("code").agg(F.count_distinct("year", "semester").alias("n_terms")), "code", "left"),
    oracle(", c as (select requires as seed, code from prerequisite where requires in ('00000012', '00000123') union select c.seed, e.code from c join prerequisite e on e.requires = c.code) select seed, code, n_terms from c left join (select code, count(distinct year * 10 + semester) as n_terms from plan_item group by code) using (code)"),
)
add(
    "g4_earlier_year",
    lambda s, d: graph.earlier_year(_plan(s, d), _pre(s, d)),
    oracle(f", t as materialized (select distinct {S}, code, year from plan_item), e as materialized (select distinct code, requires from prerequisite) select a.program, a.edition, a.track, a.code, a.year, requires, b.year as requires_year from t a join e on e.code = a.code join t b on b.code = requires and (a.program, a.edition, a.track) = (b.program, b.edition, b.track) where b.year < a.year"),
)
add("g5_degrees", lambda s, d: graph.degrees(_pre(s, d)), oracle("select kind, count(*) as n_edges, count(distinct code) as n_codes, count(distinct requires) as n_required from prerequisite group by kind"))
add("g6_dedupe_edges", lambda s, d: graph.dedupe_edges(roles.cyclic_prerequisite(s, d)), oracle("select distinct code, requires, kind from cyclic_prerequisite where code <> requires"))
