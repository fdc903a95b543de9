"""Queries over rules that read which rows a table's cell covers."""

from __future__ import annotations

from plantables.operators import pages, spans
from plantables.plans.registry import add
from plantables.sources.roles import spread, table

N1, N2, N3, N4, N5, N6, N7 = ("lpad('' || (o_orderkey % 10000000 + " + n + "), 8, '2')" for n in "0123456")
#: An order as a page whose table has a choice with one credits cell, two codes with an "or" row (for even orders), a row without a code, and a cell of two codes with a separator (but for every third order).
PAGE = f"""'<table><tr><th>Code</th><th>Name</th><th>Credits</th></tr><tr><td rowspan=2>' || {N1} || '<br>or ' || {N2} || '</td><td>Work at home</td><td rowspan=2>6 (0-35-0)</td></tr><tr><td>or work abroad</td></tr>'
|| '<tr><td rowspan=2>' || {N3} || ' ' || {N4} || '</td><td>Project one</td><td>6(0-35-0)</td></tr><tr><td>' || case when o_orderkey % 2 = 0 then 'or ' else '' end || 'Project two</td><td></td></tr>'
|| '<tr><td rowspan=2>' || {N5} || '</td><td>Law for all</td><td>3(3-0-6)</td></tr><tr><td>Group of courses<br>Professional  talk<br>talk in English</td><td>3(2-2-5)</td></tr>'
|| '<tr><td rowspan=2>0601xxxx<br>' || {N7} || '</td><td>ก 1<br>Elective 1<br>' || case when o_orderkey % 3 = 0 then '' else '(Faculty requirement)<br>' end || 'ข<br>Modern business</td><td>3(3-0-6)</td></tr><tr><td>ค 1<br>General 1</td><td>3(3-0-6)</td></tr></table>'"""
#: The rows that were read: ordinal, page, code, name, name_en, credits, year, semester, category, type, alt_group, inferred.
READ = [
    f"(1, 1, {N3}, 'Project one', null, '6(0-35-0)', 2, 1, 'M', 'core', null, false)", f"(2, 1, {N4}, 'Project one', null, null, 2, 1, 'M', 'core', null, false)", f"(3, 1, {N3}, ' or Project two', null, null, 2, 1, 'M', 'core', 'recovered-1', false)",
    f"(4, 1, {N5}, 'Law for all', null, '3(3-0-6)', 3, 2, 'G', 'core', null, false)", "(5, 1, '0601XXXX', 'ก 1 ข', 'Elective 1', '3(3-0-6)', 3, 1, 'E', 'free', null, false)", f"(6, 1, {N7}, 'ค 1', 'General 1', '3(3-0-6)', 3, 1, 'E', 'free', null, false)",
    "(7, 2, '0602xxxx', 'ค 1', null, null, 4, 1, 'E', 'free', null, true)", f"(8, 5, {N7}, 'ข', null, '3(3-0-6)', null, null, 'C', 'core', null, false)", "(9, 5, '0601xxxx', 'ก 1', null, '3(3-0-6) or 3(2-2-5)', null, null, 'E', 'free', null, false)",
]
FIELDS = "ordinal int, page int, code string, name string, name_en string, credits string, year int, semester int, category string, type string, alt_group string, inferred boolean"


def _values(row: str) -> list[str]:
    """The twelve expressions of a row; commas in parentheses don't part them."""
    out, depth, now = [], 0, ""
    for c in row[1:-1]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def _grid(s, d):
    return pages.grid_rows(pages.explode_tables(spread(table(s, d, "orders"), "o_orderkey").selectExpr("o_orderkey as doc_id", "1 as page_no", f"{PAGE} as text")))


def _rows(s, d):
    names = [x.split()[0] for x in FIELDS.split(", ")]
    typed = ", ".join("named_struct(" + ", ".join(f"'{n}', cast({v} as {k.split()[1]})" for n, v, k in zip(names, _values(r), FIELDS.split(", "), strict=True)) + ")" for r in READ)
    return spread(table(s, d, "orders"), "o_orderkey").selectExpr("o_orderkey as doc_id", f"explode(array({typed})) as r").select("doc_id", "r.*")


SQL_ROWS = f"r as (select * from ({' union all '.join('select o_orderkey as doc_id, ' + ', '.join(f'{v} as {n.split()[0]}' for v, n in zip(_values(r), FIELDS.split(', '), strict=True)) + ' from orders' for r in READ)}))"

add(
    "r15_shared_credits",
    lambda s, d: spans.with_shared(_rows(s, d).filter("page = 1 and ordinal in (1, 4)").selectExpr("doc_id", "code", "credits as usable", "credits as first"), spans.shared_credits(_grid(s, d))),
    f"select o_orderkey as doc_id, unnest([{N1}, {N2}, {N3}, {N5}]) as code, unnest(['6(0-35-0)', '6(0-35-0)', '6(0-35-0)', '3(3-0-6)']) as usable, unnest(['6(0-35-0)', '6(0-35-0)', '6(0-35-0)', '3(3-0-6)']) as first from orders",
)
add(
    "r20_codeless_rows",
    lambda s, d: spans.codeless_rows(_grid(s, d), table(s, d, "orders").selectExpr("o_orderkey as doc_id", f"explode(array(struct('Professional talk' as name, {N6} as code), struct('Group of courses' as name, {N6} as code), struct('work abroad' as name, {N2} as code), struct('work abroad' as name, {N3} as code))) as x").select("doc_id", "x.*"), _rows(s, d), "^Group"),
    f"select o_orderkey as doc_id, 1 as page, {N6} as code, 'Professional talk' as name, 'talk in English' as name_en, '3(2-2-5)' as credits, 3 as year, 2 as semester, 'G' as category, 'core' as type, 'no code in its row, below ' || {N5} as note from orders",
)
add(
    "r21_or_rows",
    lambda s, d: spans.group_or_rows(_rows(s, d), _grid(s, d)).select("doc_id", "ordinal", "alt_group"),
    f"with {SQL_ROWS} select doc_id, ordinal, case when doc_id % 2 = 0 and ordinal < 3 then 'alt_y2s1_or_' || lpad('' || (doc_id % 10000000 + 2), 8, '2') else alt_group end as alt_group from r where doc_id % 2 = 1 or ordinal <> 3",
)
add(
    "r22_split_merged_cells",
    lambda s, d: spans.split_merged_cells(_rows(s, d), _grid(s, d), "Faculty requirement", table(s, d, "orders").selectExpr("o_orderkey as doc_id", "2 as page_no", "case when o_orderkey % 5 = 0 then '<td>ค</td> 1' else 'other' end as text")).select("doc_id", "ordinal", "page", "name", "name_en", "credits", "category", "type", "year", "semester", "note"),
    f"""with {SQL_ROWS}, k as (select *, doc_id % 3 > 0 as split, doc_id % 3 > 0 and doc_id % 5 > 0 and ordinal = 7 as moves from r)
select doc_id, ordinal, case when moves then 1 else page end as page, case when split and ordinal = 5 then 'ก 1' when split and ordinal = 6 then 'ข' else name end as name, case when split and ordinal = 5 then 'Elective 1' when split and ordinal = 6 then 'Modern business' else name_en end as name_en,
case when split and ordinal = 5 then '3(3-0-6) or 3(2-2-5)' else credits end as credits, case when split and ordinal = 6 then 'C' else category end as category, case when split and ordinal = 6 then 'core' else type end as type, case when moves then 3 else year end as year, semester,
case when moves then 'moved to the page that prints its name' when split and ordinal = 5 then 'name parted from the next one of its cell' when split and ordinal = 6 then 'had the name of the row below its cell' end as note from k""",
)
