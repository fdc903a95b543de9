"""Queries over conversion of rows and what is left in tables and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantables.functions import text as f
from plantables.operators import checks, convert, pages, repair
from plantables.plans.paged import ITEMS, LINES, html_pages, lines
from plantables.plans.registry import add
from plantables.sources import roles
from plantables.sources.roles import SCOPE, oracle, spread, table

EXTRACTED = "case when l_partkey % 5 = 0 then lpad('' || l_partkey, 8, '0') || ' or ' || lpad('' || (l_partkey + 1), 8, '0') when l_partkey % 5 = 1 then lpad('' || l_partkey % 1000, 5, '9') || 'xxx' else lpad('' || l_partkey, 8, '0') end"
CREDITS = "case when l_partkey % 7 = 0 then 'abc' else (l_partkey % 9) || '(1-2-x)' end"


def extracted(s, d):
    return table(s, d, "lineitem").selectExpr(
        *(f"{e} as {n}" for n, e in roles.PLAN_ITEM if n in SCOPE), f"{dict(roles.PLAN_ITEM)['id']} as ordinal", f"{EXTRACTED} as code", "'n' || l_partkey as name", f"{CREDITS} as credits",
        "cast(case when l_linenumber > 5 then 0 else l_linenumber end as int) as year", "cast(l_orderkey % 3 + 1 as int) as semester", "l_returnflag as category", "case when l_partkey % 4 = 0 then 'see ' || lpad('' || (l_partkey + 2), 8, '0') end as prerequisite",
    )


SQL_ROWS = (
    f", e as (select {', '.join(f'{e} as {n}' for n, e in roles.PLAN_ITEM if n in SCOPE)}, {dict(roles.PLAN_ITEM)['id']} as ordinal, l_partkey as k, l_linenumber as ln, l_orderkey % 3 + 1 as semester, l_returnflag as category, case when l_partkey % 7 > 0 then l_partkey % 9 end as c from lineitem), "
    "x as (select *, unnest(case when k % 5 = 0 then [lpad('' || k, 8, '0'), lpad('' || (k + 1), 8, '0')] when k % 5 = 1 then ['PLACEHOLDER_' || lpad('' || (k % 1000), 5, '9') || 'XXX'] else [lpad('' || k, 8, '0')] end) as code from e)"
)
add(
    "r3_convert_plan",
    lambda s, d: convert.convert_rows(extracted(s, d), SCOPE)["plan"].select("ordinal", "code", "year", "semester", "credits", "alt_group"),
    oracle(f"{SQL_ROWS} select ordinal, code, ln as year, cast(semester as int) as semester, cast(coalesce(c, 0) as int) as credits, case when k % 5 = 0 then 'alt-' || ordinal end as alt_group from x where ln <= 5"),
)
add(
    "r3_convert_counts",
    lambda s, d: convert.convert_rows(extracted(s, d), SCOPE)["counts"],
    oracle(f"{SQL_ROWS} select program, edition, track, cast(count_if(ln <= 5) as bigint) as n_plan, cast(count_if(ln > 5) as bigint) as n_slot, cast(count_if(k % 5 = 1) as bigint) as n_placeholder, cast(count_if(k % 7 = 0) as bigint) as n_unreadable from x group by all"),
)
add(
    "r3_convert_prerequisites",
    lambda s, d: convert.convert_rows(extracted(s, d), SCOPE)["prerequisite"],
    oracle(f"{SQL_ROWS} select distinct code, lpad('' || (k + 2), 8, '0') as requires, 'pre' as kind from x where k % 4 = 0 and k % 5 <> 1 and code <> lpad('' || (k + 2), 8, '0')"),
)
add(
    "r3_rejected_rows",
    lambda s, d: convert.convert_rows(extracted(s, d).withColumn("code", F.expr("case ordinal % 5 when 0 then code when 1 then null when 2 then ' ' when 3 then 'see page 9' else code end")), SCOPE)["rejected"].select("ordinal", "reason"),
    oracle("select id as ordinal, case when id % 5 < 3 then 'no code' else 'code not read' end as reason from plan_item where id % 5 in (1, 2, 3)"),
)
add(
    "r14_printed_credits",
    lambda s, d: convert.printed_credits(pages.table_rows(pages.explode_tables(html_pages(s, d))).filter("row_no > 0").select((F.col("doc_id") % 100).alias("doc_id"), F.element_at("cells", -2).alias("code"), F.element_at("cells", -1).alias("credits"))),
    oracle(f"select k % 100 as doc_id, code, count(distinct credits) as n_values, case when count(distinct credits) = 1 then '' || min(credits) end as usable from ({ITEMS}) group by k % 100, code"),
)
#: One grid row a table: several courses and a total in one cell, two cells with and without more behind the code, credits alone, a total, and a whole row.
MERGED = [
    "id as doc_id", "1 as page_no", "0 as table_no", "0 as row_no",
    """case id % 6 when 0 then array(lpad('' || id, 8, '0') || ' name a\nand more 3(3-0-6)\n' || lpad('' || (id + 1), 8, '0') || ' B 2 (2-0-4) 0602xxxx C 1(0-2-1)\nTotal 6\nlost')
    when 1 then array(lpad('' || id, 8, '0'), 'name ' || year || ' 3(1-0-x)\nTotal 9\n') when 2 then array(lpad('' || id, 8, '0') || ' group\nof it', '\nname 4(1-1-1) end')
    when 3 then array(' ' || credits || '(1-0-2)') when 4 then array('Total', '21') else array('c', 'n 3(3-0-6)', '') end as cells""",
]
add(
    "t4_normalize_rows",
    lambda s, d: convert.normalize_grid_rows(
        roles.plan_item(s, d).selectExpr(*MERGED).withColumns({"inherited": F.transform("cells", lambda _: F.lit(False)), "origin": F.transform("cells", lambda _: F.lit(0))})
    ).select("doc_id", "row_no", "kind", F.array_join("cells", "|").alias("cells")),
    oracle(
        """, w as (select id, lpad('' || id, 8, '0') as a, lpad('' || (id + 1), 8, '0') as b, year, credits, id % 6 as m from plan_item),
x as (select id, unnest(case m
  when 0 then [{'k': 'course', 'c': a || '|name a\nand more|3(3-0-6)'}, {'k': 'course', 'c': b || '|B|2 (2-0-4)'}, {'k': 'course', 'c': '0602xxxx|C|1(0-2-1)'}, {'k': 'total', 'c': 'Total|Total|6'}]
  when 1 then [{'k': 'course', 'c': a || '|name ' || year || '|3(1-0-x)'}, {'k': 'total', 'c': 'Total|Total|9'}]
  when 2 then [{'k': 'course', 'c': a || '|group\nof it\nname 4(1-1-1) end|'}]
  when 3 then [{'k': 'credits', 'c': '|| ' || credits || '(1-0-2)'}] when 4 then [{'k': 'row', 'c': 'Total|21'}] else [{'k': 'row', 'c': 'c|n 3(3-0-6)|'}] end) as x, unnest(range(case m when 0 then 4 when 1 then 2 else 1 end)) as n from w)
select id as doc_id, cast(n as int) as row_no, x.k as kind, replace(x.c, '\n', chr(10)) as cells from x"""
    ),
)
#: Rows of a table in runs: three of one code, an elective whose credits go on, a row again without credits.
REPEATS = [
    "o_orderkey as k", "o_orderkey * 1000 + n as pos", "case when n <= 3 then 'A' when n <= 6 then '0602xxx' else 'C' end as code",
    "case when n <= 3 then 'a long course name ' || cast(floor((n + o_orderkey % 2) / 2) as int) when n <= 6 then 'Elective ' || case when o_orderkey % 3 = 0 then n else 1 end else 'other' end as name",
    "case when n <= 3 then '3(3-0-6)' when n = 4 then '3(3-0-6) or ' when n = 5 then '3(2-2-5)' when n = 7 then '1(0-2-1)' end as credits", "n not in (1, 4, 7) as inherited", "n in (6, 8) as inherited_name",
]
add(
    "t10_drop_repeated",
    lambda s, d: convert.drop_repeated(spread(table(s, d, "orders"), "o_orderkey").selectExpr("o_orderkey", "explode(sequence(1, 8)) as n").selectExpr(*REPEATS), ["k"]).select("pos", "credits"),
    "select k * 1000 + n as pos, case n when 4 then '3(3-0-6) or 3(2-2-5)' when 6 then null when 7 then '1(0-2-1)' else '3(3-0-6)' end as credits from (select o_orderkey as k, unnest(range(1, 9)) as n from orders) where case n when 1 then true when 2 then k % 2 = 0 when 3 then k % 2 = 1 when 4 then true when 6 then k % 3 = 0 when 7 then true else false end",
)
SLIPPED = "case when n = 4 and o_orderkey % 2 = 0 then '0602xxxx' else lpad('' || (o_orderkey * 10 + n) % 100000000, 8, '1') end as code"
add(
    "t11_realign_codes",
    lambda s, d: convert.realign_codes(table(s, d, "orders").selectExpr("o_orderkey", "explode(sequence(1, 4)) as n").selectExpr("o_orderkey as k", "n as pos", SLIPPED, "'name ' || n as name", "n = 2 and o_orderkey % 3 > 0 as elective"), ["k"], "06026xxx").select("k", "pos", "code"),
    f"""with p as (select o_orderkey, unnest(range(1, 5)) as n from orders), r as (select o_orderkey as k, n, {SLIPPED}, lpad('' || (o_orderkey * 10 + n - 1) % 100000000, 8, '1') as prev, o_orderkey % 3 > 0 as slipped from p)
select k, cast(n as int) as pos, case when n = 2 and slipped then '06026xxx' when n > 2 and slipped and k % 2 = 0 then prev else code end as code from r""",
)
add(
    "t11_number_series",
    lambda s, d: convert.number_series(roles.plan_item(s, d).selectExpr("cast(floor(id / 1000) as bigint) as k", "category", "id as ordinal", "cast(case when id % 3 = 0 then id % 11 end as int) as number"), ["k", "category"]).select("ordinal", "number"),
    oracle(
        ", p as (select cast(floor(id / 1000) as bigint) as k, category, id, case when id % 3 = 0 then id % 11 end as n from plan_item) select id as ordinal, cast(coalesce(n, coalesce(max(n) over (partition by k, category), 0) + row_number() over (partition by k, category, n is not null order by id)) as int) as number from p"
    ),
)
add(
    "t12_catalog_fallback",
    lambda s, d: convert.catalog_fallback(roles.plan_item(s, d).selectExpr("cast(floor(id / 1000) as bigint) as doc_id", "code"), roles.plan_item(s, d).filter("credits > 3").selectExpr("cast(floor(id / 1000) as bigint) as doc_id", "code"), roles.plan_item(s, d).filter("id % 10 = 1").selectExpr("cast(floor(id / 5000) as bigint) as doc_id")),
    oracle(", l as (select cast(floor(id / 1000) as bigint) as doc_id, code from plan_item) select * from l where doc_id not in (select cast(floor(id / 5000) as bigint) from plan_item where id % 10 = 1) and (doc_id, code) not in (select (cast(floor(id / 1000) as bigint), code) from plan_item where credits > 3)"),
)
add(
    "t14_code_by_name",
    lambda s, d: convert.code_by_name(
        spread(table(s, d, "part"), "p_partkey").selectExpr("cast(floor(p_partkey / 50) as bigint) as doc_id", "p_partkey as id", "case when p_partkey % 2 = 0 then 'PLACEHOLDER_90000XXX' else 'own' end as code", "case p_partkey % 8 when 2 then '#' when 4 then 'xy' when 6 then 'nothing like it ' else '' end || p_name || ' ' || p_brand || ' ' || p_partkey as name"),
        spread(table(s, d, "part"), "p_partkey").selectExpr("cast(floor(p_partkey / 50) as bigint) as doc_id", "lpad('' || p_partkey, 8, '0') as code", "p_name || ' ' || p_brand || ' ' || p_partkey as name"),
    ).select("id", "code"),
    "select p_partkey as id, case when p_partkey % 2 = 1 then 'own' when p_partkey % 8 = 6 then 'PLACEHOLDER_90000XXX' else lpad('' || p_partkey, 8, '0') end as code from part",
)
add(
    # names of 9 and 11 characters with 9 in common are alike at 18/20, just enough; with 8 of 8 and 10 at 16/18 they aren't
    "t14_code_by_label",
    lambda s, d: convert.code_by_name(
        table(s, d, "part").selectExpr("p_partkey as doc_id", "p_partkey as id", "'PLACEHOLDER_90000XXX' as code", "case p_partkey % 4 when 0 then 'Set* abX cdefYghi' when 1 then 'Set* abXcdYefgh' when 2 then 'abcdefghi' else 'Set*abcdefghi' end as name"),
        table(s, d, "part").selectExpr("p_partkey as doc_id", "lpad('' || p_partkey, 8, '0') as code", "case p_partkey % 4 when 1 then 'Set* abcdefgh' else 'Set* abcdefghi' end as name"),
        label=r"Set\*",
    ).select("id", "code"),
    "select p_partkey as id, case when p_partkey % 4 in (0, 3) then lpad('' || p_partkey, 8, '0') else 'PLACEHOLDER_90000XXX' end as code from part",
)
add(
    "d1_description_blocks",
    lambda s, d: convert.description_blocks(lines(s, d).select("doc_id", F.col("page_no").alias("line_no"), F.col("text").alias("line")), "^(The|Of|In) ", "ly\\.?$").select("doc_id", "line_no", "opens", "block"),
    f"with {LINES}, f as (select *, max(cast(regexp_matches(text, 'ly\\.?$') as int)) over (partition by doc_id order by page_no rows between 1 following and 4 following) as m from lines), o as (select doc_id, page_no as line_no, regexp_matches(text, '^(The|Of|In) ') and coalesce(m, 0) = 1 as opens from f) select *, cast(sum(cast(opens as int)) over (partition by doc_id order by line_no rows unbounded preceding) as bigint) as block from o",
)
#: An order as description lines: headings, a course with a list of codes over lines, one of a bare code, and a bare code that opens none.
BOOK = [
    "'Category ' || o_orderpriority", "'Group ' || o_orderstatus", "'00000001 First (3-0-6)'", "'Pre of'", "'00000002'", "'00000003 listed'", "'Prerequisite: none'", "'text one'", "'Category two'",
    "'00000004'", "'a second name'", "case when o_orderkey % 2 = 0 then 'Prerequisite: 00000001' else 'nothing' end", "'00000005 Third 3 (3-0-6)'", "'last words'",
]


def _book(s, d):
    at = spread(table(s, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(*map(F.expr, BOOK))).alias("line_no", "line"))
    return convert.description_blocks(at, r"^[0-9]{8}\b", "^Prerequisite", bare=r"^[0-9]{8}\s*$", listed=("^Pre of", "^Prerequisite"), category="^Category", group="^Group")


add(
    "d1_listed_and_headings",
    lambda s, d: _book(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", "block", "category", "group"),
    f"""with l as (select o_orderkey as k, o_orderpriority as p, o_orderstatus as s, unnest(range(0, {len(BOOK)})) as n from orders)
select k as doc_id, n as line_no, case when n in (0, 8) then 'category' when n = 1 then 'group' when n in (2, 12) or n = 9 and k % 2 = 0 then 'head' when n in (4, 5) then 'listed' else 'text' end as kind,
cast((n >= 2) :: int + (n >= 9 and k % 2 = 0) :: int + (n >= 12) :: int as bigint) as block, case when n >= 8 then 'Category two' else 'Category ' || p end as category, case when n between 1 and 7 then 'Group ' || s end as "group" from l""",
)
add(
    "d2_parse_listed",
    lambda s, d: convert.parse_blocks(_book(s, d).withColumn("page_no", F.floor(F.col("line_no") / 5).cast("int"))).select("doc_id", "code", "name", "credits", "prerequisite", "description", "pages", "category", "group"),
    """select o_orderkey as doc_id, unnest(['00000001', '00000005']) as code, unnest(['First', 'Third']) as name, unnest(['3(3-0-6)', '3(3-0-6)']) as credits, unnest(['00000002 00000003', null]) as prerequisite, unnest([case when o_orderkey % 2 = 0 then 'Pre of text one' else 'Pre of text one 00000004 a second name nothing' end, 'last words']) as description,
unnest([case when o_orderkey % 2 = 0 then [0, 1] else [0, 1, 2] end, [2]]) as pages, unnest(['Category ' || o_orderpriority, 'Category two']) as category, unnest(['Group ' || o_orderstatus, null]) as "group" from orders
union all select o_orderkey, '00000004', null, null, '00000001', 'a second name', [1, 2], 'Category two', null from orders where o_orderkey % 2 = 0""",
)
#: Letters of the first script in LONG.
THAI = "[\u0e01-\u0e5b]"
#: An order as blocks: a head over five lines with a note, one that text ends, numbers of a series, and credits alone, of nothing and behind a label.
LONG = [
    "'00000001 วิชาหนึ่ง'", "'เลือก 3 หน่วยกิต'", "case when o_orderkey % 3 = 0 then 'และสอง AI' else 'และสอง' end", "'3(3-0-6)'", "'FIRST COURSE'", "'AND ' || o_orderstatus", "'Prerequisite: 00000009'", "'ข้อความ'", "'left out'", "'เลือก 3 หน่วยกิต'",
    "'00000002 3 (3-0-6)'", "'ชื่อ ' || o_orderkey || ' Name Two'", "'ตอน 9(9-9-9)'", "'more'", "'จบ'",
    "'00000003 หัวข้อ 3 (3-0-6)'", "case when o_orderkey % 2 = 0 then '00000004 หัวข้อ 2 (6-0-12)' else '*note*' end", "'00000005 ฝึกงาน 0 (0-0-45)'", "'PRACTICE'", "'00000006 (1-0-2)'", "'Prerequisite: none'", "'4(4-0-8)'",
]


def _long(s, d):
    at = spread(table(s, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(*map(F.expr, LONG))).alias("line_no", "line"))
    return convert.description_blocks(at, r"^[0-9]{8}\b", "^Prerequisite", bare=r"^[0-9]{8}\s*$").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "block", "line")


add(
    "d2_head_roles",
    lambda s, d: convert.head_roles(_long(s, d), THAI, "^Prerequisite", "^เลือก [0-9]+ หน่วยกิต").select("doc_id", "line_no", "block", "role"),
    f"""with l as (select o_orderkey as k, unnest(range(0, {len(LONG)})) as n from orders)
select k as doc_id, n as line_no, cast(1 + (n >= 10) :: int + (n >= 15) :: int + (n >= 16 and k % 2 = 0) :: int + (n >= 17) :: int + (n >= 19) :: int as bigint) as block,
case when n in (6, 20) then 'pre' when n in (3, 21) then 'credits' when n = 1 then 'note' when n in (7, 9, 12, 14) then 'text' when n in (8, 13) then 'other' else 'head' end as role from l""",
)
add(
    "d2_long_heads",
    lambda s, d: convert.parse_blocks(_long(s, d), "^Prerequisite", native=THAI, note="^เลือก [0-9]+ หน่วยกิต").selectExpr("doc_id", "code", "name", "name_en", "credits", "prerequisite", "description", "n_blocks"),
    """with o as (select o_orderkey as k, o_orderstatus as s from orders)
select k as doc_id, '00000001' as code, 'วิชาหนึ่งและสอง' || case when k % 3 = 0 then ' AI' else '' end as name, 'FIRST COURSE AND ' || s as name_en, '3(3-0-6)' as credits, '00000009' as prerequisite, 'ข้อความ เลือก 3 หน่วยกิต' as description, 1 :: bigint as n_blocks from o
union all select k, '00000002', 'ชื่อ ' || k, 'Name Two', '3(3-0-6)', null, 'ตอน 9(9-9-9) จบ', 1 from o
union all select k, '00000003', case when k % 2 = 0 then 'หัวข้อ 3' else 'หัวข้อ' end, case when k % 2 = 0 then null else 'note' end, '3(3-0-6)', null, null, 1 from o
union all select k, '00000004', 'หัวข้อ 2', null, '6(6-0-12)', null, null, 1 from o where k % 2 = 0
union all select k, '00000005', 'ฝึกงาน', 'PRACTICE', '0(0-0-45)', null, null, 1 from o
union all select k, '00000006', null, null, '4(4-0-8)', null, null, 1 from o""",
)
add(
    "a6_evaluate_extraction",
    lambda s, d: convert.evaluate_extraction(
        roles.plan_item(s, d).filter("id % 4 < 3").selectExpr("* except (type)", "id as ordinal", "case when id % 7 > 0 then category end as name", "upper(type) || ' ' as type", "code as prerequisite"), roles.plan_item(s, d).filter("id % 4 > 0").selectExpr("* except (type)", "id as ordinal", "category as name", "case when id % 5 = 0 then type || 'x' else type end as type", "cast(null as string) as prerequisite"), [["program", "code", "year"], ["program", "code"]], ["name", "type", "prerequisite"]
    ).drop("sub", "del", "ins", "samples"),
    oracle(
        """, t as (select *, row_number() over (partition by program, code, year order by id) as n from plan_item where id % 4 < 3 and id % 7 > 0), p as (select *, row_number() over (partition by program, code, year order by id) as n, min(id) over (partition by program, code, year) as lead from plan_item where id % 4 > 0),
a as (select t.id as t_id, p.id as p_id from t join p using (program, code, year, n)),
u as (select program, code, id, row_number() over (partition by program, code order by id) as n from t where id not in (select t_id from a)), v as (select program, code, id, row_number() over (partition by program, code order by lead, id) as n from p where id not in (select p_id from a)),
m as (select t_id, p_id from a union all select u.id, v.id from u left join v using (program, code, n)), b as (select y.id as hit, lower(x.code) as pre, lower(x.category) as tn, lower(x.type) as tt, coalesce(lower(y.category), '') as pn, coalesce(lower(case when y.id % 5 = 0 then y.type || 'x' else y.type end), '') as pt from m join plan_item x on x.id = t_id left join plan_item y on y.id = p_id),
e as (select 'name' as field, tn as r, pn as h from b union all select 'type', tt, pt from b union all select 'prerequisite', pre, '' from b where hit is not null)
select field, count(*) as items, cast(count_if(r = h) as bigint) as exact, cast(count_if(r <> '' and h = '') as bigint) as missing, cast(count_if(r = '' and h <> '') as bigint) as hallucinated, cast(sum(levenshtein(r, h)) as bigint) as errors, cast(sum(length(r)) as bigint) as ref_length, round(cast(sum(levenshtein(r, h)) as double) / cast(sum(length(r)) as double), 6) as cer, cast(case when field = 'name' then count_if(r <> h) else 0 end as bigint) as word_errors, cast(case when field = 'name' then count(*) else 0 end as bigint) as ref_words, case when field = 'name' then round(count_if(r <> h) / count(*), 6) else 0.0 end as wer from e group by field"""
    ),
)
add(
    "f15_clean_name",
    lambda s, d: table(s, d, "part").selectExpr("p_partkey", "case when p_partkey % 5 = 0 then 'University' else 'ก ข' || '  หมวด ' || p_size || '(3-0-6) Alpha ' || 'AI' || case when p_partkey % 2 = 0 then ' (x' else '' end end as x").select("p_partkey", f.clean_name_primary(F.col("x"), ["หมวด"]).alias("y")),
    "select p_partkey, case when p_partkey % 5 = 0 then 'University' else 'กข AI' || case when p_partkey % 2 = 0 then ' x' else '' end end as y from part",
)
add(
    "f15_clean_second_name",
    lambda s, d: table(s, d, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then '# 5 ' || upper(p_name) || ' (AB' when 1 then '3(3-0-6)' else upper(p_name) || '  1 (3-0-6) NOTE)' end as x").select("p_partkey", f.clean_name_secondary(F.col("x"), ["NOTE"]).alias("y")),
    "select p_partkey, case p_partkey % 3 when 0 then upper(p_name) || ' AB' when 1 then '3(3-0-6)' else upper(p_name) end as y from part",
)
add(
    "f24_split_by_script",
    lambda s, d: table(s, d, "part").selectExpr("p_partkey", "'กข ' || p_size || '\\n' || p_name || case when p_partkey % 3 > 0 then '\\nคง\\n' || p_brand else '' end as x").select("p_partkey", f.split_by_script(F.col("x"), 2).alias("y")),
    "select p_partkey, case when p_partkey % 3 > 0 then ['กข ' || p_size || chr(10) || p_name, 'คง' || chr(10) || p_brand] end as y from part",
)


def _blocks(s, d):
    """An order's items as description lines: head, prerequisite, two of text."""
    items = roles.plan_item(s, d).selectExpr("cast(floor(id / 1000) as bigint) % 50 as doc_id", "id", "code", "credits", "year").filter("code like '0%'")
    parts = F.array(
        F.expr("code || ' Name ' || year || ' ' || credits || '(1-2-3)'"), F.expr("case when id % 3 = 0 then 'Prerequisite: none' else 'Prerequisite: 00000001 00000002' end"), F.expr("'text ' || year"), F.lit("more")
    )
    return items.select("doc_id", F.col("id").alias("block"), F.posexplode(parts).alias("line_no", "line"))


add(
    "d2_parse_blocks",
    lambda s, d: convert.parse_blocks(_blocks(s, d)).drop("name_en"),
    oracle(
        """, i as (select cast(floor(id / 1000) as bigint) % 50 as doc_id, id, code, credits, year from plan_item where code like '0%') select doc_id, code, 'Name ' || arg_min(year, id) as name, arg_min(credits, id) || '(1-2-3)' as credits, max(case when id % 3 <> 0 then '00000001 00000002' end) as prerequisite, 'text ' || arg_min(year, id) || ' more' as description, count(*) as n_blocks from i group by doc_id, code"""
    ),
)
add(
    "r15_repair_credits",
    lambda s, d: convert.repair_credits(
        roles.dealt(roles.plan_item(s, d).selectExpr("program as doc_id", "code", "id", "case id % 4 when 0 then '3' when 1 then null else credits || '(1-2-3)' end as credits", "id % 5 = 0 as inferred"), table(s, d, "lineitem").count(), "doc_id", "code"),
        roles.course(s, d).filter("credits is not null").select(F.explode(F.array(*(F.lit(f"P{i}") for i in range(4)))).alias("doc_id"), "code", F.expr("case when credits % 3 > 0 then credits || '(1-2-3)' end as usable"), F.expr("credits || '(1-2-3)' as first")),
    ).select("id", "credits", "rule"),
    oracle(
        """, c as (select code, credits || '(1-2-3)' as f, case when credits % 3 > 0 then credits || '(1-2-3)' end as u from course where credits is not null), r as (select id, program, code, case id % 4 when 0 then '3' when 1 then null else credits || '(1-2-3)' end as x from plan_item),
j as (select r.*, case when program <> 'P4' then f end as f, case when program <> 'P4' then u end as u from r left join c using (code)), k as (select *, case when coalesce(x, '') in ('3', '') and f is not null then 'blank' when id % 5 = 0 and u is not null then 'inferred' when u is not null and x <> u then 'differs' end as rule from j)
select id, case when rule = 'blank' then f when rule is not null then u else x end as credits, rule from k"""
    ),
)
def _orders(s, d, *columns: str):
    return table(s, d, "orders").selectExpr("o_orderkey as doc_id", *columns)


HEADED = "explode(array(struct(0 as row_no, array('Code', '3 (3-0-6) 1(0-2-1)') as cells), struct(1 as row_no, array('0000 0001', 'a') as cells), struct(2 as row_no, array('00000002', 'b') as cells), struct(3 as row_no, case when o_orderkey % 3 = 0 then array('00000003', 'c') else array('00000003', 'c', '2(2-0-4)') end as cells))) as x"
add(
    "r15_credits_from_header",
    lambda s, d: convert.credits_from_header(
        _orders(s, d, "explode(array(struct('00000001' as code, cast(null as string) as credits), struct('00000002' as code, case when o_orderkey % 2 = 0 then '' else '9(9-0-18)' end as credits), struct('00000003' as code, null as credits))) as r").select("doc_id", "r.*"),
        _orders(s, d, "1 as page_no", "1 as table_no", HEADED).select("doc_id", "page_no", "table_no", "x.*"), _orders(s, d, "case when o_orderkey % 5 = 0 then '00000001' else 'zz' end as code"),
    ),
    """with o as (select o_orderkey as k from orders), r as (select k, unnest([1, 2, 3]) as n from o)
select k as doc_id, '0000000' || n as code, case when n = 1 and k % 3 > 0 and k % 5 > 0 then '3(3-0-6)' when n = 2 and k % 2 = 0 and k % 3 > 0 then '1(0-2-1)' when n = 2 and k % 2 = 0 then '' when n = 2 then '9(9-0-18)' end as credits,
case when k % 3 > 0 and (n = 1 and k % 5 > 0 or n = 2 and k % 2 = 0) then 'header' end as rule from r""",
)
SEVERAL = "case o_orderkey % 4 when 0 then '3(3-0-6) 3(2-2-5)' when 1 then '3 (3-0-6) or 1(0-2-1)' when 2 then '3(3-0-6)' end"
add(
    "r15_credits_by_name",
    lambda s, d: convert.credits_by_name(
        _orders(s, d, "o_orderpriority as name", f"{SEVERAL} as credits"),
        _orders(s, d, "replace(o_orderpriority, '-', ' - ') as name", "explode(case o_orderkey % 3 when 0 then array('2(2-0-4)', '2 (2-0-4)', '') when 1 then array('2(2-0-4)', '3(3-0-6)') else array('2(2-0-4)', '3(3-0-6) or 3(2-2-5)') end) as credits"),
    ),
    f"select o_orderkey as doc_id, o_orderpriority as name, case when o_orderkey % 4 < 2 and o_orderkey % 3 = 0 then '2(2-0-4)' else {SEVERAL} end as credits, case when o_orderkey % 4 < 2 and o_orderkey % 3 = 0 then 'name' end as rule from orders",
)
add(
    "r19_fill_second_name",
    lambda s, d: convert.fill_second_name(roles.plan_item(s, d).selectExpr("program as doc_id", "code", "id", "case when id % 2 = 0 then category end as name_en"), roles.plan_item(s, d).selectExpr("program as doc_id", "code", "category as name_en")).select("id", "name_en"),
    oracle(
        ", a as (select program, code, case when count(distinct category) = 1 then min(category) end as e from plan_item group by all) select id, case when id % 2 = 0 then category when regexp_full_match(code, '[0-9]{8}') then e end as name_en from plan_item join a using (program, code)"
    ),
)
SKILL = "'SKILL ' || o_custkey || ' 3'"
add(
    "r19_strip_credit_digit",
    lambda s, d: convert.strip_credit_digit(
        table(s, d, "orders").selectExpr("o_orderkey as doc_id", "1 as ordinal", "'c' || o_custkey as code", f"{SKILL} as name_en", "'3(3-0-6)' as credits"),
        table(s, d, "orders").selectExpr("o_orderkey as doc_id", f"'some words, ' || case o_orderkey % 5 when 2 then 'X' when 3 then '(' else '' end || {SKILL} || case when o_orderkey % 5 = 4 then ' (2-2-5)' else ' <b>( 3-0 -6)' end || case when o_orderkey % 5 = 1 then '<td> ' || {SKILL} || '</td>' else '' end as text"),
        table(s, d, "orders").selectExpr("o_orderkey as doc_id", "'c' || o_custkey as code", "case when o_orderkey % 5 = 3 then 'SKILL ' || o_custkey || ' 1' else 'SKILL' end as name_en"),
    ).select("doc_id", "name_en"),
    f"select o_orderkey as doc_id, case o_orderkey % 5 when 0 then 'SKILL ' || o_custkey when 3 then 'SKILL ' || o_custkey || ' 1' else {SKILL} end as name_en from orders",
)
add(
    "r20_recover_alternatives",
    lambda s, d: convert.recover_alternatives(
        roles.plan_item(s, d).filter("alt_group is not null").selectExpr("alt_group as doc_id", "cast(year as int) as page", "semester as grp", "code", "category as name").distinct(),
        roles.plan_item(s, d).filter("alt_group is not null and id % 3 > 0").selectExpr("alt_group as doc_id", "code", "year + 1 as page", "id as ordinal", "year", "semester", "alt_group"),
    ),
    oracle(
        """, o as (select distinct alt_group as doc_id, year as page, semester as grp, code, category as name from plan_item where alt_group is not null), r as (select * from plan_item where alt_group is not null and id % 3 > 0),
m as (select o.*, row_number() over (partition by o.doc_id, o.page, o.grp, o.code order by r.id, o.name) as n, r.year, r.semester, r.alt_group from o join o b using (doc_id, page, grp) join r on r.alt_group = o.doc_id and r.code = b.code where (o.doc_id, o.code) not in (select (alt_group, code) from r))
select doc_id, page, code, name, year, semester, alt_group from m where n = 1"""
    ),
)
add(
    "r21_group_cell_codes",
    lambda s, d: convert.group_cell_codes(
        roles.plan_item(s, d).selectExpr("program as doc_id", "cast(floor(id / 1000) as int) as page", "id as ordinal", "code", "year", "semester", "case when id % 1000 > 3 then alt_group end as alt_group"),
        roles.plan_item(s, d).filter("id % 1000 <= 3").groupBy(F.col("program").alias("doc_id"), F.expr("cast(floor(id / 1000) as int)").alias("page"), F.col("semester").alias("cell")).agg(F.collect_list("code").alias("codes")),
    ).select("ordinal", "alt_group"),
    oracle(
        """, r as (select program, cast(floor(id / 1000) as int) as page, id, code, semester, year * 10 + semester as term, case when id % 1000 > 3 then alt_group end as g from plan_item),
c as (select program, page, semester as cell, list_sort(list_distinct(list(code))) as codes from r where id % 1000 <= 3 group by all), e as (select *, unnest(codes) as code from c),
m as (select e.*, r.id, r.term from e join r using (program, page, code) where g is null), w as (select program, page, cell from m group by program, page, cell, codes having count(*) >= 2 and min(term) = max(term) and (program, codes) not in (select (program, list_sort(list_distinct(list(code)))) from r where g is not null group by program, g)),
n as (select program, id, min('cell-' || page || '-' || cell) as x from m join w using (program, page, cell) group by all) select r.id as ordinal, coalesce(g, x) as alt_group from r left join n using (program, id)"""
    ),
)
add(
    "r22_term_from_cell",
    lambda s, d: convert.term_from_cell(
        roles.plan_item(s, d).selectExpr("program as doc_id", "id", "code", "'long enough ' || id as name", "case when id % 1000 <> 1 then year end as year", "case when id % 1000 <> 1 then semester end as semester"),
        roles.plan_item(s, d).selectExpr("program as doc_id", "cast(floor(id / 1000) as bigint) as cell", "code", "'long enough ' || id as name"),
    ).select("id", "year", "semester"),
    oracle(
        """, r as (select program, id, cast(floor(id / 1000) as bigint) as cell, code, case when id % 1000 <> 1 then year end as year, case when id % 1000 <> 1 then semester end as semester from plan_item),
p as (select distinct a.program, a.cell, b.year, b.semester from r a join r b using (program, code) where b.year is not null), t as (select program, cell, min(year) as y, min(semester) as s from p group by all having count(*) = 1)
select id, coalesce(year, y) as year, case when year is null then s else semester end as semester from r left join t using (program, cell)"""
    ),
)
add(
    "r28_split_by_variant",
    lambda s, d: convert.split_by_variant(
        roles.plan_item(s, d).selectExpr("program as doc_id", "pages[0] as page_no", "id as ordinal", "code", "year", "semester", "category", "alt_group").filter("page_no is not null"),
        s.createDataFrame([(f"P{i}", x, a, b) for i in range(5) for x, a, b in (("coop", 20, 60), ("nocoop", 50, 90))], "doc_id string, section string, start int, end int"),
        [lambda r: repair.dissolve_mixed_groups(r, ["doc_id", "year", "semester"]), lambda r: repair.last_term_only(r, ["doc_id"])],
    )[1],
    oracle(
        """, r as (select program as doc_id, pages[1] as p, code, year * 10 + semester as t from plan_item where pages is not null), k as (select * from (select *, max(t) over (partition by doc_id, code) as m from r) where t = m), s as (select * from (values ('coop', 20, 60), ('nocoop', 50, 90)) v(section, a, b))
select doc_id, section, count(*) as n_rows, count(distinct code) as n_codes from k, s where p between a and b or p not between 20 and 90 group by all"""
    ),
)
#: An order as a document of three pages. A plan table under a heading, with a pair, a row without credits, a series whose credits
#: aren't all printed, and rows without a code (one whose name ends as a described one, one too short). On the same page a table with
#: its term in its own header row, of merged rows. Then, without a heading, the table's end on a page of the variant with co-op, and
#: descriptions with names, credits and prerequisites.
K1, K2, K3, K4, K5, K6 = ("lpad('' || (o_orderkey % 10000000 + " + n + "), 8, '1')" for n in "012345")
PLAN_PAGE = f"""'Plan without co-op\nYear ' || (o_orderkey % 4 + 1) || ' Semester ' || (o_orderkey % 2 + 1) || '\n<table><tr><th>Code</th><th>Name</th><th>Credits</th></tr>'
|| '<tr><td rowspan=2>' || {K1} || '<br>or ' || {K2} || '</td><td>First course of many</td><td>3(3-0-6)</td></tr><tr><td>Second course of many</td><td></td></tr>'
|| '<tr><td>' || {K3} || '</td><td>Third course of many</td><td></td></tr>'
|| '<tr><td>999</td><td>Skill A</td><td>1(0-2-1)</td></tr><tr><td>1111</td><td>advanced Topics in Data</td><td>3(3-0-6)</td></tr>'
|| '<tr><td>0603xxxx</td><td>Skill 1</td><td>1(0-2-1)</td></tr><tr><td>0604xxxx</td><td>Skill 3</td><td></td></tr>'
|| '</table>text<table><tr><th colspan=2>Year 5 Semester summer</th></tr><tr><th>Code</th><th>Name</th></tr>'
|| '<tr><td>' || {K4} || ' Fourth course<br>of many 1(0-2-1)<br>' || {K5} || ' Fifth course 2(2-0-4)<br>Total 3</td></tr></table>'"""
NEXT_PAGE = f"""'Plan co-op\n<table><tr><td>' || {K5} || '</td><td>Fifth course</td><td>2(2-0-4)</td></tr></table>'"""
TEXT_PAGE = f"""{K1} || ' First course of many 3(3-0-6)\nPrerequisite: none\nwords\n' || {K3} || ' Third course of many 2(2-0-4)\nPrerequisite: ' || {K1} || '\nmore\n' || {K2} || ' Skill A\nPrerequisite: none\n' || {K6} || ' Topics in Data\nPrerequisite: none'"""


def _books(s, d):
    listed = ", ".join(f"struct({n} as page_no, {text} as text)" for n, text in enumerate((PLAN_PAGE, NEXT_PAGE, TEXT_PAGE), 1))
    return spread(table(s, d, "orders"), "o_orderkey").selectExpr("o_orderkey as doc_id", f"explode(array({listed})) as p").select("doc_id", "p.*")


add(
    "t5_table_terms",
    lambda s, d: (lambda b: pages.table_terms(b, pages.grid_rows(pages.explode_tables(b)), r"(?i)year\s*([0-9]+)\s*semester\s*([0-9]+|summer)", r"(?i)plan (without )?co-?op"))(_books(s, d)),
    "select o_orderkey as doc_id, unnest([1, 1, 2]) as page_no, unnest([0, 1, 0]) as table_no, unnest([cast(o_orderkey % 4 + 1 as int), 5, 5]) as year, unnest([cast(o_orderkey % 2 + 1 as int), 3, 3]) as semester, unnest(['nocoop', 'nocoop', 'coop']) as variant from orders",
)
_ALT = "'alt_y' || (o_orderkey % 4 + 1) || 's' || (o_orderkey % 2 + 1) || '_1'"
add(
    "r28_convert_plan",
    lambda s, d: convert.convert_documents(_books(s, d))["plan"].select("doc_id", "code", "year", "semester", "credits", "alt_group"),
    f"""select o_orderkey as doc_id, unnest([{K1}, {K2}, {K3}, {K6}, 'PLACEHOLDER_0603XXXX', 'PLACEHOLDER_0604XXXX', {K4}, {K5}, {K5}]) as code,
unnest([cast(o_orderkey % 4 + 1 as int) for x in range(6)] || [5, 5, 5]) as year, unnest([cast(o_orderkey % 2 + 1 as int) for x in range(6)] || [3, 3, 3]) as semester, unnest([3, 3, 2, 3, 1, 3, 1, 2, 2]) as credits,
unnest([{_ALT}, {_ALT}, null, null, null, null, null, null, null]) as alt_group from orders""",
)
add(
    # R4 gives a row its code; R7 takes the described names; the description has credits and prerequisites of the third course; the series of skills has other credits for its third
    "r28_convert_log",
    lambda s, d: convert.convert_documents(_books(s, d))["log"].select("doc_id", "ordinal", "field", "old", "new", "rule", "step"),
    f"""select o_orderkey as doc_id, unnest([5, 2, 5, 3, 3, 7]) as ordinal, unnest(['code', 'name', 'name', 'credits', 'prerequisite', 'credits']) as field, unnest([null, 'Second course of many', 'advanced Topics in Data', null, null, null]) as old,
unnest([{K6}, 'Skill A', 'Topics in Data', '2(2-0-4)', {K1}, '3(0-6-3)']) as new, unnest(['R4', 'R7', 'R7', 'D4', 'D4', 'R13']) as rule, unnest([1, 3, 3, 4, 4, 5]) as step from orders""",
)
add(
    "r28_convert_rejected",
    lambda s, d: convert.convert_documents(_books(s, d))["rejected"].select("doc_id", "code", "name", "reason"),
    "select o_orderkey as doc_id, cast(null as varchar) as code, 'Skill A' as name, 'no code' as reason from orders",
)
add(
    "r28_convert_prerequisites",
    lambda s, d: convert.convert_documents(_books(s, d))["prerequisite"],
    f"select distinct {K3} as code, {K1} as requires, 'pre' as kind from orders",
)
add(
    "c0_program_present",
    lambda s, d: checks.program_present(roles.plan_item(s, d), roles.plan_item(s, d).filter("not (program = 'P3' and track = 1)").select(*SCOPE).distinct()),
    oracle("select distinct program, edition, track from plan_item where program = 'P3' and track = 1"),
)
