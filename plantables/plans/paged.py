"""Queries over pages, sections and tables; text is made of documents and line items, and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantables.operators import pages
from plantables.plans.registry import add
from plantables.sources import roles
from plantables.sources.roles import spread, table


def lines(s, d):
    """Documents as one line a page, from 1."""
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page_no"), "text")


LINES = "lines as (select doc_id, cast(unnest(range(1, len(l) + 1)) as int) as page_no, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents))"

add("p1_page_spec", lambda s, d: pages.filter_pages(lines(s, d), "2-4, 7, 9-8"), f"with {LINES} select * from lines where page_no in (2, 3, 4, 7, 8, 9)")
add(
    "p2_merge_parts",
    lambda s, d: pages.merge_parts(lines(s, d).select("doc_id", F.col("page_no").alias("part"), F.floor(F.col("page_no") / 3).cast("int").alias("page_no"), "text")).select("doc_id", "page_no", "text"),
    f"with {LINES} select doc_id, cast(floor(page_no / 3) as int) as page_no, string_agg(text, chr(10) order by page_no) as text from lines group by doc_id, cast(floor(page_no / 3) as int)",
)
add(
    "p3_chunk_pages",
    lambda s, d: pages.chunk_pages(lines(s, d).filter("page_no % 5 <> 0").select("doc_id", "page_no"), 3),
    f"with {LINES}, i as (select doc_id, page_no, page_no // 5 as k, (page_no % 5 - 1) // 3 as c from lines where page_no % 5 <> 0) select doc_id, page_no, cast(dense_rank() over (partition by doc_id order by k, c) as int) as chunk from i",
)
PATTERNS = {"first": "^The ", "second": "^(Of|And) "}
add(
    "p4_detect_sections",
    lambda s, d: pages.sections(lines(s, d), PATTERNS, "ly\\.$"),
    f"""with {LINES}, f as (select doc_id, min(case when regexp_matches(text, '^The ') then page_no end) as a, min(case when regexp_matches(text, '^(Of|And) ') then page_no end) as b, max(page_no) as last from lines group by doc_id),
e as (select doc_id, last, 'first' as section, a as start from f where a is not null union all select doc_id, last, 'second', b from f where b is not null), n as (select *, lead(start) over (partition by doc_id order by start, section) as nxt from e)
select doc_id, section, start, coalesce((select min(page_no) from lines l where l.doc_id = n.doc_id and regexp_matches(text, 'ly\\.$') and page_no >= start and (nxt is null or page_no < nxt)), greatest(start, nxt - 1) , last) as end from n""".replace(
        "greatest(start, nxt - 1)", "case when nxt is not null then greatest(start, nxt - 1) end"
    ).replace(" as end from n", ' as "end" from n'),
)
add(
    "p4_sections_inferred",
    lambda s, d: pages.sections(lines(s, d), {"coop": "^The and", "nocoop": "^Was ", "text": "^In "}, "ly\\.$", ["coop", "nocoop"], ("plan", "^Of "), ("nocoop", "coop", "^And ")).select("doc_id", "section", "start"),
    f"""with {LINES}, f as (select doc_id, min(case when regexp_matches(text, '^The and') then page_no end) as c, min(case when regexp_matches(text, '^Was ') then page_no end) as n, min(case when regexp_matches(text, '^In ') then page_no end) as t, min(case when regexp_matches(text, '^Of ') then page_no end) as g, min(case when regexp_matches(text, '^And ') then page_no end) as l from lines group by doc_id),
h as (select doc_id, c, coalesce(n, case when l < c then l end) as n, t, g from f)
select * from (select doc_id, 'coop' as section, c as start from h union all select doc_id, 'nocoop', n from h union all select doc_id, 'text', t from h union all select doc_id, 'plan', case when c is null and n is null then g end from h) where start is not null""",
)
add(
    "p5_shared_codes",
    lambda s, d: pages.assign_section(lines(s, d).select("doc_id", "page_no", F.concat(F.lit("c"), F.col("page_no") % 7).alias("code")), table(s, d, "documents").select("doc_id", F.explode(F.expr("array(struct('a' as section, 1 as start, 4 as `end`), struct('b' as section, 5 as start, 1000000 as `end`))")).alias("s")).select("doc_id", "s.*"), s.createDataFrame([("c3",)], "code string")).select("doc_id", "page_no", "section"),
    f"with {LINES} select doc_id, page_no, case when page_no <= 4 then 'a' else 'b' end as section from lines where page_no % 7 <> 3 union all select doc_id, page_no, unnest(['a', 'b']) from lines where page_no % 7 = 3",
)
add(
    "p5_assign_section",
    lambda s, d: pages.assign_section(lines(s, d).select("doc_id", "page_no"), lines(s, d).groupBy("doc_id").agg(F.max("page_no").alias("n")).filter("n > 3").select("doc_id", F.explode(F.expr("array(struct('a' as section, 2 as start, 4 as `end`), struct('b' as section, 4 as start, 6 as `end`))")).alias("s")).select("doc_id", "s.*")),
    f"""with {LINES}, p as (select doc_id, page_no from lines where doc_id in (select doc_id from lines group by doc_id having max(page_no) > 3)), s as (select * from (values ('a', 2, 4), ('b', 4, 6)) v(section, f, l))
select doc_id, page_no, section from p, s where page_no between f and l or page_no not between 2 and 6""",
)
#: Lines that hold tables, codes, wildcards, and digits that are none.
MADE = "text || case page_no % 6 when 0 then ' <table border=1>' when 1 then ' 0123' || (10000 + page_no % 10000) when 2 then ' 0602xxx.' when 3 then ' 1234567890' when 4 then ' xxxxxxxx' else '' end"
add(
    "p6_description_pages",
    lambda s, d: lines(s, d).selectExpr("doc_id", "page_no", f"{MADE} as text").select("doc_id", "page_no", pages.is_description_page(F.col("text"), ["license", "License", "the"]).alias("described"), pages.has_content(F.col("text")).alias("content")),
    f"with {LINES}, m as (select doc_id, page_no, {MADE} as text from lines) select doc_id, page_no, regexp_matches(text, '[lL]icense|the') and not contains(text, '<table') as described, contains(text, '<table') or regexp_matches(text, '(^|[^0-9xX])([0-9]{{8}}|[0-9]{{2,7}}[xX]{{1,6}}|[xX]{{8}})($|[^0-9xX])') as content from m",
)
add(
    "p7_page_lines",
    lambda s, d: pages.page_lines(table(s, d, "documents").select("doc_id", F.replace("text", F.lit("the"), F.lit("&lt;the&gt;")).alias("text"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line"),
    r"""with l as (select doc_id, unnest(range(0, len(x))) as line_no, trim(unnest(x), ' ') as line from (select doc_id, string_split(replace(text, 'the', '<the>'), chr(10)) as x from documents)) select * from l where not regexp_matches(line, '^\s*(-{3,}|<!--.*-->|[0-9]{1,3})?\s*$')""",
)
add(
    "p8_drop_ungrounded",
    lambda s, d: pages.drop_ungrounded(table(s, d, "documents").selectExpr("doc_id", "doc_id * 2 as id", "array('THE', 'of' || (case when doc_id % 2 = 0 then 'the' else '' end)) as codes"), table(s, d, "documents")).select("id"),
    r"select doc_id * 2 as id from documents where contains(regexp_replace(lower(text), '\s+', '', 'g'), 'the') and contains(regexp_replace(lower(text), '\s+', '', 'g'), case when doc_id % 2 = 0 then 'ofthe' else 'of' end)",
)
add(
    "p9_mode_line",
    lambda s, d: pages.mode_last_line(lines(s, d).withColumnRenamed("text", "line")),
    f"with {LINES}, c as (select doc_id, text as line, count(*) as n from lines group by all having count(*) > 1) select * exclude (r) from (select *, row_number() over (partition by doc_id order by n desc, line) as r from c) where r = 1",
)
add(
    "p9_unique_total",
    lambda s, d: pages.unique_total(lines(s, d).withColumnRenamed("text", "line"), "([0-9]{1,4})"),
    f"with {LINES}, t as (select doc_id, try_cast(nullif(regexp_extract(text, '([0-9]{{1,4}})', 1), '') as int) as total from lines) select doc_id, min(total) as total from t where total is not null group by doc_id having count(distinct total) = 1",
)
add(
    "p10_clean_model_output",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.lit("<think>{x}</think> so ```json\n{oops "), F.to_json(F.struct("o_orderkey", F.struct("o_orderstatus").alias("s"))), F.lit(" ```")).alias("x")).select("o_orderkey", pages.first_json("x").alias("y")),
    """select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"s":{"o_orderstatus":"' || o_orderstatus || '"}}' as y from orders""",
)

add(
    "p10_first_sql",
    lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", "'<think>select x</think>Sure:\\n```sql\\n' || case o_orderkey % 3 when 0 then 'SELECT a\\nfrom t' when 1 then 'with q as (select 1) select * from q' else 'no query' end || ';\\n``` done' as x").select("o_orderkey", pages.first_sql("x").alias("y")),
    "select o_orderkey, case o_orderkey % 3 when 0 then 'SELECT a' || chr(10) || 'from t' when 1 then 'with q as (select 1) select * from q' end as y from orders",
)


def html_pages(s, d):
    """One table an order: the order's key spans its rows; then part and quantity, by line."""
    items = roles.plan_item(s, d).selectExpr("cast(floor(id / 1000) as bigint) as k", "id", "code", "credits")
    rows = items.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("id", "code", "credits"))).alias("r"))
    cells = F.transform("r", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size("r").cast("string"), F.lit('">'), F.col("k").cast("string"), F.lit("</td>"))).otherwise(""), F.lit("<td> "), x["code"], F.lit("<br/></td><td><b>"), x["credits"].cast("string"), F.lit("</b></td></tr>")))
    return rows.select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), F.concat(F.lit("Plan <table><tr><th>Key</th><th>Code</th><th>Credits</th></tr>"), F.array_join(cells, ""), F.lit("</table> end")).alias("text"))


ITEMS = "select cast(floor(id / 1000) as bigint) as k, row_number() over (partition by cast(floor(id / 1000) as bigint) order by id) as n, code, credits from plan_item"
add("t1_explode_tables", lambda s, d: pages.explode_tables(html_pages(s, d)).select("doc_id", "table_no", F.size(F.regexp_extract_all("html", F.lit("<tr>"), F.lit(0))).alias("n")), roles.oracle(f"select k as doc_id, 0 as table_no, cast(count(*) + 1 as int) as n from ({ITEMS}) group by k"))
add(
    "t2_table_rows",
    lambda s, d: pages.table_rows(pages.explode_tables(html_pages(s, d))).filter("row_no > 0").select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.element_at("cells", -2).alias("code"), F.element_at("cells", -1).alias("credits"), F.size("cells").alias("width")),
    roles.oracle(f"select k as doc_id, n as row_no, code, '' || credits as credits, case when n = 1 then 3 else 2 end as width from ({ITEMS})"),
)
def rough_pages(s, d):
    """html_pages with a span one row too long and then a row of three, spans quoted otherwise, entities, a figure, line ends, and a broken header."""
    text = F.regexp_replace("text", r'<tr><td rowspan="([0-9]+)">', "<tr><td rowspan = '1$1'>")
    text = F.replace(text, F.lit("<tr><th>Key</th><th>Code</th><th>Credits</th></tr>"), F.lit('<tr><th rowspan="2">Key<th>Code<td>Credits</td></th></th></tr>'))
    text = F.replace(F.replace(text, F.lit("<br/></td>"), F.lit("<br/>&amp;&nbsp; x<figure>seen</figure></td>")), F.lit("</table>"), F.lit("<tr><td>X</td><td>Y</td><td COLSPAN=1>Z</td></tr></table>"))
    return html_pages(s, d).withColumn("text", text)


add(
    "t3_table_grid",
    lambda s, d: pages.grid_rows(pages.explode_tables(rough_pages(s, d))).select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("cells")[0].alias("key"), F.col("cells")[1].alias("code"), F.col("cells")[2].alias("credits"), F.col("inherited")[0].alias("inherited"), F.size("cells").alias("width")),
    roles.oracle(
        f"""select k as doc_id, n as row_no, '' || k as key, code || chr(10) || '& x' as code, '' || credits as credits, n > 1 as inherited, 3 as width from ({ITEMS}) union all select distinct k, 0, 'Key', 'Code', 'Credits', false, 3 from ({ITEMS}) union all select k, count(*) + 1, 'X', 'Y', 'Z', false, 3 from ({ITEMS}) group by k"""
    ),
)
add(
    "t5_carry_headings",
    lambda s, d: pages.carry_headings(lines(s, d).select("doc_id", "page_no", F.lit(0).alias("pos"), F.when(F.col("text").rlike("^The "), F.substring("text", 1, 20)).alias("h")), "h").select("doc_id", "page_no", "carried"),
    f"with {LINES} select doc_id, page_no, last_value(case when regexp_matches(text, '^The ') then substring(text, 1, 20) end ignore nulls) over (partition by doc_id order by page_no rows unbounded preceding) as carried from lines",
)
add(
    "t6_locate_columns",
    lambda s, d: pages.table_rows(pages.explode_tables(html_pages(s, d))).filter("row_no = 0").select("doc_id", pages.locate_column(F.col("cells"), "code", 0).alias("code"), pages.locate_column(F.col("cells"), "credit", 2).alias("credits"), pages.locate_column(F.col("cells"), "name", 1).alias("name")),
    roles.oracle(f"select distinct k as doc_id, 1 as code, 2 as credits, 1 as name from ({ITEMS})"),
)
C1, C2, W = "lpad('' || o_orderkey % 10000000, 8, '0')", "lpad('' || (o_orderkey % 10000000 + 1), 8, '0')", "lpad('' || o_orderkey % 1000, 4, '9')"
#: Tables of alternatives and of plain rows, one an order: a pair in a cell over two rows, a code cell that ends with "or", a row that
#: begins with it, codes of one cell without it, one name for a pair, wildcards in one cell, credits torn over rows, and names without codes.
SHAPES = [
    f"'<tr><td rowspan=2>' || {C1} || '<br>or ' || {C2} || '</td><td>One</td><td>3(3-0-6)</td></tr><tr><td>Two</td><td>2 (2-0-4)</td></tr>'",
    f"'<tr><td>' || {C1} || ' OR</td><td>One</td><td>3(3-0-6)</td></tr><tr><td>' || {C2} || '</td><td>Two</td><td></td></tr>'",
    f"'<tr><td>' || {C1} || '</td><td>One</td><td>3(3-0-6)</td></tr><tr><td>or ' || {C2} || '</td><td>Two</td><td>1(0-3-0)</td></tr>'",
    f"'<tr><td rowspan=\"2\">' || {C1} || '<br>' || {C2} || '</td><td>One</td><td>3(3-0-6)</td></tr><tr><td>Two</td><td></td></tr>'",
    f"'<tr><td>' || {C1} || ' / ' || {C2} || ' or</td><td>Both</td><td>3(3-0-6)</td></tr>'",
    f"'<tr><td rowspan=2>' || {W} || 'xxxx<br>' || {W} || 'xxxx</td><td>Choice 1</td><td>3(3-0-6)</td></tr><tr><td>Choice 2</td><td></td></tr>'",
    f"'<tr><td rowspan=3>' || {C1} || '</td><td>One</td><td>3(3-0-6)</td></tr><tr><td>or</td><td></td></tr><tr><td></td><td>3(2-2-5)</td></tr>'",
    f"'<tr><td></td><td></td><td>4(4-0-8)</td></tr><tr><td rowspan=2>' || {C1} || '</td><td>One</td><td></td></tr><tr><td>Lost</td><td></td></tr>'",
]
SHAPE = "case o_orderkey % 8 " + " ".join(f"when {i} then {x}" for i, x in enumerate(SHAPES)) + " end"


def _grouped(s, d):
    html = spread(table(s, d, "orders"), "o_orderkey").selectExpr("cast(floor(o_orderkey / 64) as bigint) as doc_id", "o_orderkey as page_no", f"'<table><tr><th>Code</th><th>Name</th><th>Credits</th></tr>' || {SHAPE} || '<tr><td>Total</td><td></td><td>9</td></tr></table>' as text")
    return pages.group_rowspan_rows(pages.grid_rows(pages.explode_tables(html)))


#: By shape the entries that it must give: group, entry, code, name, credits, and whether they are a choice.
ENTRIES = [
    (0, 1, 0, C1, "One", "3(3-0-6)", True), (0, 1, 1, C2, "Two", "2(2-0-4)", True), (1, 1, 0, C1, "One", "3(3-0-6)", True), (1, 1, 1, C2, "Two", "3(3-0-6)", True),
    (2, 1, 0, C1, "One", "3(3-0-6)", True), (2, 2, 0, C2, "Two", "1(0-3-0)", True), (3, 1, 0, C1, "One", "3(3-0-6)", False), (3, 1, 1, C2, "Two", "3(3-0-6)", False),
    (4, 1, 0, C1, "Both", "3(3-0-6)", True), (4, 1, 1, C2, "Both", "3(3-0-6)", True), (5, 1, 0, f"{W} || 'xxxx'", "Choice 1", "3(3-0-6)", False), (5, 1, 1, f"{W} || 'xxxx'", "Choice 2", "3(3-0-6)", False),
    (6, 1, 0, C1, "One", "3(3-0-6) or 3(2-2-5)", False), (7, 1, 0, C1, "One", "4(4-0-8)", False), (7, 1, 1, "null", "Lost", "4(4-0-8)", False),
]
WANTED = " union all ".join(f"select o_orderkey as page_no, {g} as grp, {e} as entry, {c} as code, '{n}' as name, '{x}' as credits, {str(a).lower()} as choice from orders where o_orderkey % 8 = {i}" for i, g, e, c, n, x, a in ENTRIES)
add(
    "t7_rowspan_groups",
    lambda s, d: pages.group_entries(_grouped(s, d)).select("page_no", F.col("grp").cast("int").alias("grp"), "entry", "code", "name", "credits"),
    f"select page_no, grp, entry, code, name, credits from ({WANTED})",
)
add(
    "t8_alt_groups",
    lambda s, d: pages.assign_alt_groups(pages.group_entries(_grouped(s, d)), table(s, d, "orders").selectExpr("cast(floor(o_orderkey / 64) as bigint) as doc_id", "o_orderkey as page_no", "0 as table_no", "cast(o_orderkey % 3 + 1 as int) as year", "1 as semester")).select("page_no", F.col("grp").cast("int").alias("grp"), "entry", "alt_group"),
    f"""with w as ({WANTED}), n as (select page_no, row_number() over (partition by page_no // 64, page_no % 3 order by page_no) as n from (select distinct page_no from w where choice))
select page_no, grp, entry, case when choice then 'alt_y' || (page_no % 3 + 1) || 's1_' || n end as alt_group from w left join n using (page_no)""",
)
add(
    "t6_skipped_tables",
    lambda s, d: pages.skipped_tables(pages.grid_rows(pages.explode_tables(spread(table(s, d, "orders"), "o_orderkey").selectExpr("o_orderkey as doc_id", "1 as page_no", f"'<table>' || case when o_orderkey % 5 > 0 then '<tr><th>Code</th><th>Name</th></tr>' else '' end || '<tr><td>' || case when o_orderkey % 7 = 0 then 'none' else {C1} end || '</td><td>n</td></tr></table>' as text"))).withColumns({"year": F.when(F.col("doc_id") % 3 > 0, 1), "semester": F.lit(1)})).select("doc_id", "reason", "codes"),
    f"select o_orderkey as doc_id, case when o_orderkey % 5 > 0 then 'no term' else 'no header and no term' end as reason, [{C1}] as codes from orders where o_orderkey % 3 = 0 and o_orderkey % 7 > 0",
)
add(
    "t9_term_totals",
    lambda s, d: pages.term_totals(roles.plan_item(s, d).selectExpr("program as doc_id", "year * 10 + semester as heading", "id as pos", "alt_group", "credits", "case when program <> 'P1' then cast(1000 + year as bigint) end as printed")),
    roles.oracle(
        ", o as (select program, year * 10 + semester as h, coalesce(alt_group, 'x' || id) as g, arg_max(credits, id) as c, max(case when program <> 'P1' then cast(1000 + year as bigint) end) as printed from plan_item group by all) select program as doc_id, h as heading, cast(sum(c) as bigint) as credits, max(printed) as printed, coalesce(sum(c) = max(printed), true) as ok from o group by all"
    ),
)
add(
    "t13_line_course_rows",
    lambda s, d: pages.line_course_rows(
        roles.plan_item(s, d).selectExpr("cast(floor(id / 1000) as bigint) as doc_id", "id as line_no", "case when id % 5 = 0 then category || ' group:' else code || '  name ' || year || ' ' || credits || '(1-' || semester || '-x)' end as line")
    ),
    roles.oracle(
        """, l as (select cast(floor(id / 1000) as bigint) as doc_id, id as line_no, category, code, year, semester, credits, last_value(case when id % 5 = 0 then category || ' group' end ignore nulls) over (partition by cast(floor(id / 1000) as bigint) order by id rows unbounded preceding) as c from plan_item)
select doc_id, line_no, c as category, code, 'name ' || year as name, credits || '(1-' || semester || '-x)' as credits from l where line_no % 5 <> 0 and regexp_full_match(code, '[0-9]{8}')"""
    ),
)
