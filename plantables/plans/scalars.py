"""Queries over the scalar functions, on text made of the part, documents and line item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantables.functions import text as f
from plantables.plans.registry import add
from plantables.sources.roles import table

CREDITS = "case when p_size % 11 = 0 then 'x' when p_size % 7 = 0 then '' || (p_size % 20) when p_size % 5 = 0 then (p_size % 9) || ' (' || (p_size % 4) || '-x-' || (p_size % 6) || ')' else (p_size % 15) || '(' || (p_size % 4) || '-' || (p_size % 3) || '-' || (p_size % 6) || ')' end"
CODES = "case when p_partkey % 3 = 0 then lpad('' || p_partkey, 8, '0') || ' or ' || lpad('' || (p_partkey + 7), 8, '0') when p_partkey % 3 = 1 then lpad('' || (p_partkey % 90 + 10), 5, '9') || 'xx' else 'none' end"


def part(s, d, *columns: str):
    return table(s, d, "part").selectExpr("p_partkey", *columns)


def scalar(name, column, made, sql):
    """A function on one text column x of part, next to its SQL."""
    add(name, lambda s, d: part(s, d, f"{column} as x").select("p_partkey", made(F.col("x")).alias("y")), f"select p_partkey, {sql} as y from (select p_partkey, {column} as x from part)")


add(
    "f1_normalize_text",
    lambda s, d: table(s, d, "documents").select("doc_id", f.normalize_text(F.col("text"), "word").alias("word"), F.length(f.normalize_text(F.col("text"), "strict")).alias("n_strict")),
    r"select doc_id, lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) as word, cast(length(regexp_replace(lower(nfc_normalize(text)), '\s+', '', 'g')) as int) as n_strict from documents",
)
#: DuckDB has no NFKC and no case folding, so there is no oracle; tests/test_operators.py has cases.
add("f2_canonical", lambda s, d: table(s, d, "documents").select("doc_id", f.canonical("text").alias("y")))
add(
    "f3_whole_word",
    lambda s, d: table(s, d, "documents").select("doc_id", f.whole_word(F.col("text"), "License").alias("a"), f.whole_word(F.col("text"), "the").alias("b")),
    "select doc_id, cast(regexp_matches(lower(text), '(^|[^a-z0-9_])license($|[^a-z0-9_])') as int) as a, cast(regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') as int) as b from documents",
)
add(
    "f4_contains_ignoring_space",
    lambda s, d: table(s, d, "documents").select("doc_id", f.contains_ignoring_space(F.col("text"), "MIT Lic ense").alias("a")),
    r"select doc_id, cast(contains(regexp_replace(lower(text), '\s+', '', 'g'), 'mitlicense') as int) as a from documents",
)
scalar("f5_course_codes", CODES, f.course_codes, "regexp_extract_all(x, '[0-9]{8}')")
EIGHT = "lpad('' || p_partkey % 10000000, 8, '0')"
#: Pairs of codes, short and long wildcards, x only, x inside, a space inside, Thai digits, codes parted by a space, and none.
LISTED = f"case p_partkey % 9 when 0 then {EIGHT} || ' or ' || {EIGHT} when 1 then lpad('' || p_partkey, 5, '9') || 'xX' when 2 then 'xXXXXXXXXX' when 3 then '06x36xxx' when 4 then '0603 ' || right({EIGHT}, 4) when 5 then {EIGHT} || '/๐๖๐๓๖๑๑๕' when 6 then {EIGHT} || ' 0603xxxxxx' when 7 then {EIGHT} || '1, none' else 'หรือ ' || {EIGHT} end"
add(
    "f6_split_code_alternatives",
    lambda s, d: table(s, d, "part").selectExpr("p_partkey", f"{LISTED} as x").select("p_partkey", f.split_code_alternatives(F.col("x")).alias("y")),
    f"""with c as (select p_partkey, {EIGHT} as c, rpad(lpad('' || p_partkey, 5, '9'), 8, 'x') as w from part)
select p_partkey, case p_partkey % 9 when 0 then [c, c] when 1 then [w] when 2 then ['xxxxxxxx'] when 3 then ['06x36xxx'] when 4 then ['0603' || right(c, 4)] when 5 then [c, '06036115'] when 6 then [c, '0603xxxx'] when 7 then []::varchar[] else [c] end as y from c""",
)
scalar("f7_placeholder_code", CODES, f.placeholder_code, "case when regexp_full_match(upper(x), '[0-9]+X+') then 'PLACEHOLDER_' || upper(x) end")
scalar("f8_is_real_code", "case when p_size % 5 = 0 then p_name else lpad('' || p_partkey, case when p_size % 3 = 0 then 7 else 8 end, '0') end", f.is_real_code, "regexp_full_match(x, '[0-9]{8}')")
TRIPLE = r"\s*([0-9]{1,2})\s*\(\s*([0-9]{1,2}|[xX])\s*-\s*([0-9]{1,2}|[xX])\s*-\s*([0-9]{1,2}|[xX])\s*\)\s*"
add(
    "f9_parse_credits",
    lambda s, d: part(s, d, f"{CREDITS} as x").select("p_partkey", f.parse_credits(F.col("x")).alias("c")).select("p_partkey", "c.credits", "c.lecture", "c.lab", "c.self", "c.error"),
    f"""with a as (select p_partkey, {CREDITS} as x from part), b as (select *, coalesce(try_cast(nullif(regexp_extract(x, '^{TRIPLE}$', 1), '') as int), try_cast(nullif(regexp_extract(x, '^([0-9]{{1,2}})$', 1), '') as int)) as c from a)
select p_partkey, case when c <= 12 then c end as credits, case when c <= 12 then try_cast(nullif(regexp_extract(x, '^{TRIPLE}$', 2), '') as int) end as lecture, case when c <= 12 then try_cast(nullif(regexp_extract(x, '^{TRIPLE}$', 3), '') as int) end as lab, case when c <= 12 then try_cast(nullif(regexp_extract(x, '^{TRIPLE}$', 4), '') as int) end as self, c is null or c > 12 as error from b""",
)
add(
    "f10_format_credits",
    lambda s, d: part(s, d, "p_size").select("p_partkey", f.format_credits(F.col("p_size") % 9, F.col("p_size") % 4, F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 3), F.col("p_size") % 6).alias("y")),
    "select p_partkey, case when p_size % 5 > 0 then (p_size % 9) || '(' || (p_size % 4) || '-' || (p_size % 3) || '-' || (p_size % 6) || ')' else '' || (p_size % 9) end as y from part",
)
add(
    "f11_normalize_credits_text",
    lambda s, d: part(s, d, "(p_size % 5) || ' (' || (p_size % 4) || '-0-6) / ' || (p_size % 3) || '(' || (p_size % 2) || '-0-6)' as x").select("p_partkey", f.normalize_credits_text(F.col("x")).alias("y")),
    "select p_partkey, case when a = b then a else a || ' or ' || b end as y from (select p_partkey, (p_size % 5) || '(' || (p_size % 4) || '-0-6)' as a, (p_size % 3) || '(' || (p_size % 2) || '-0-6)' as b from part)",
)
add("f12_credits_from_hours", lambda s, d: part(s, d, "p_size").select("p_partkey", f.credits_from_hours(F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_size")).alias("y")), "select p_partkey, case when h > 0 and h % 3 = 0 and h // 3 <= 12 then h // 3 end as y from (select p_partkey, p_size % 4 + p_size % 3 + p_size as h from part)")
add(
    "f13_credits_match",
    lambda s, d: part(s, d, f"{CREDITS} as x", "case when p_partkey % 2 = 0 then '' || (p_size % 15) else (p_size % 15) || ' (' || (p_size % 4) || '-' || (p_size % 3) || '-' || (p_size % 6) || ')' end as z").select("p_partkey", f.credits_match(F.col("x"), F.col("z")).alias("y")),
    f"with a as (select p_partkey, replace({CREDITS}, ' ', '') as x, case when p_partkey % 2 = 0 then '' || (p_size % 15) else (p_size % 15) || '(' || (p_size % 4) || '-' || (p_size % 3) || '-' || (p_size % 6) || ')' end as z from part) select p_partkey, x = z or (not (contains(x, '(') and contains(z, '(')) and regexp_extract(x, '^[0-9]+') <> '' and regexp_extract(x, '^[0-9]+') = regexp_extract(z, '^[0-9]+')) as y from a",
)
add(
    "f14_split_bilingual_name",
    lambda s, d: part(s, d, "'ก้าว ' || p_size || ' ข ' || p_name as x").select("p_partkey", f.split_bilingual_name(F.col("x")).alias("n")).select("p_partkey", "n.first", "n.second"),
    "select p_partkey, 'ก้าว ' || p_size || ' ข' as first, p_name as second from part",
)
add(
    "f16_join_wrapped_parts",
    lambda s, d: part(s, d, "array(p_name, '' || p_size, 'x', p_brand, 'end') as x").select("p_partkey", f.join_wrapped_parts(F.col("x")).alias("y")),
    "select p_partkey, p_name || ' ' || p_size || ' x' || p_brand || case when regexp_matches(p_brand, '[0-9]$') then ' ' else '' end || 'end' as y from part",
)
add(
    "f17_stem_and_number",
    lambda s, d: part(s, d, "p_brand").select("p_partkey", f.stem_and_number(F.concat("p_brand", F.lit(" "), (F.col("p_partkey") % 7).cast("string"))).alias("n")).select("p_partkey", "n.stem", "n.number"),
    "select p_partkey, regexp_replace(p_brand, '[0-9]+$', '') as stem, cast(regexp_extract(p_brand || (p_partkey % 7), '([0-9]+)$', 1) as int) as number from part",
)
scalar("f18_normalize_prerequisite", CODES, f.normalize_prerequisite, "array_to_string(list_sort(list_distinct(regexp_extract_all(x, '[0-9]{8}'))), ' ')")
scalar("f19_category_class", "case p_size % 4 when 0 then 'Free Elective' when 1 then 'GENERAL education' when 2 then 'core' end", f.category_class, "case when lower(x) like '%free%' then 'free_elective' when lower(x) like '%general%' then 'general_education' when x <> '' then 'specialized' end")
PAGES = "case when p_size % 6 = 0 then 'p. ' || p_size || ', 7' else '[' || p_size || ', -1, 3, ' || (p_size % 4) || ', 3]' end"
scalar("f20_positive_pages", PAGES, f.positive_pages, "case when x like '[%' then list_sort(list_distinct(list_filter(cast(x as int[]), lambda v: v > 0))) else []::int[] end")
scalar("f20_loose_pages", PAGES, f.loose_pages, "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(x, '[0-9]+'), lambda v: cast(v as int)), lambda v: v > 0)))")
scalar("f21_apply_spelling_map", "p_name", lambda c: f.apply_spelling_map(c, {"a": "4", "e": "a", "4": "é"}), "replace(replace(replace(x, 'a', '4'), 'e', 'a'), '4', 'é')")
add(
    "f22_is_subsequence",
    lambda s, d: part(s, d, "'' || (p_partkey % 1000) as x", "'' || (p_partkey * 7919) as z").select("p_partkey", f.is_subsequence(F.col("x"), F.col("z")).alias("y")),
    "select p_partkey, regexp_matches(z, '^.*' || regexp_replace(x, '(.)', '\\1.*', 'g')) as y from (select p_partkey, '' || (p_partkey % 1000) as x, '' || (p_partkey * 7919) as z from part)",
)
add(
    "f23_terms",
    lambda s, d: part(s, d, "p_size").select("p_partkey", f.term_order(F.col("p_size") % 8, F.col("p_size") % 3).alias("n"), f.term_label(F.col("p_size") % 8, F.col("p_size") % 3).alias("label")),
    "select p_partkey, p_size % 8 * 10 + p_size % 3 as n, (p_size % 8) || '/' || (p_size % 3) as label from part",
)
add(
    "f25_space_trailing_number",
    lambda s, d: part(s, d, "p_name || (p_size % 3) as x", "p_brand || ' ' || (p_size % 2) as z").select("p_partkey", f.space_trailing_number(F.col("x"), F.col("z")).alias("y")),
    "select p_partkey, case when p_size % 3 = p_size % 2 then p_name || ' ' || (p_size % 3) else p_name || (p_size % 3) end as y from part",
)
add(
    "f26_pick_credits",
    lambda s, d: part(s, d, "case when p_size % 3 = 0 then '3 or 4' else '2' end as a", "case when p_size % 4 > 0 then '' || (p_size % 5) end as b", "case when p_size % 7 > 0 then '9' end as c").select("p_partkey", f.pick_credits(F.col("a"), F.col("b"), F.col("c")).alias("y")),
    "select p_partkey, case when b is not null and contains(a, ' or ') and contains(a, b) then a else coalesce(b, c, a) end as y from (select p_partkey, case when p_size % 3 = 0 then '3 or 4' else '2' end as a, case when p_size % 4 > 0 then '' || (p_size % 5) end as b, case when p_size % 7 > 0 then '9' end as c from part)",
)
add(
    "f17_slot_number",
    lambda s, d: part(s, d, "case p_partkey % 4 when 0 then 'Elective ' || p_size || ' or group 1-4' when 1 then 'Elective' || p_size % 10 when 2 then 'Choice ' || p_partkey || '00' else 'none' end as x").select("p_partkey", f.slot_number(F.col("x")).alias("y")),
    "select p_partkey, cast(case p_partkey % 4 when 0 then case when p_size between 1 and 20 then p_size end when 1 then nullif(p_size % 10, 0) end as int) as y from part",
)
add(
    "f19_normalize_category",
    lambda s, d: part(s, d, "case p_partkey % 3 when 0 then ' Free  Elective' when 1 then 'GENERALEDUCATION' else ' core ' end as x").select("p_partkey", f.normalize_category(F.col("x"), {"free elective": "free", "general education": "general"}).alias("y")),
    "select p_partkey, case p_partkey % 3 when 0 then 'free' when 1 then 'general' else 'core' end as y from part",
)
add(
    "f20_pages_of_row",
    lambda s, d: part(s, d, "case p_partkey % 3 when 0 then '[' || p_size || ', 0]' when 1 then 'p. ' || p_size else '[]' end as x", "'' || p_partkey as z").select("p_partkey", f.pages_of_row(F.col("x"), F.col("z")).alias("y")),
    "select p_partkey, case when p_partkey % 3 < 2 and p_size > 0 then [p_size::int] else [p_partkey::int] end as y from part",
)
