"""Queries over loads and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantables.operators import convert, evaluate, load
from plantables.plans.registry import add
from plantables.sources import roles
from plantables.sources.roles import oracle, table
from plantables.sources.scratch import shared_path


def marked_pages(s, d):
    """Documents of even id with page marks between their lines; of odd id with none."""
    docs = table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    pages = F.transform("lines", lambda x, i: F.concat(F.lit("<!-- PDF_PAGE "), (i + 1).cast("string"), F.lit(" -->\n"), x))
    return docs.select("doc_id", F.array_join(pages, "\n").alias("text"))


add(
    "s1_page_text",
    lambda s, d: load.split_pages(marked_pages(s, d)).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text"),
    "select doc_id, unnest(range(1, len(l) + 1)) as page_no, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents)",
)
add(
    "s2_read_truth",
    lambda s, d: load.read_truth(
        table(s, d, "orders").filter("o_orderkey % 3 < 3").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").cast("string").alias("path")).agg(
            F.when(F.max("o_orderkey") % 2 == 0, F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("code"), F.col("l_linenumber").alias("year")))).alias("courses")))).otherwise(
                F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("code"), F.col("l_linenumber").alias("year")))))
            ).alias("text")
        )
    ).select("path", "code", "year"),
    "select '' || l_orderkey as path, '' || l_partkey as code, l_linenumber as year from lineitem join orders on o_orderkey = l_orderkey",
)
add(
    "s3_merge_truth",
    lambda s, d: load.merge_first(roles.plan_item(s, d).filter("id % 2 = 0").unionByName(roles.plan_item(s, d).filter("id % 3 = 0")).select("program", "code", "year", "semester", "id", "credits"), ["program", "code", "year", "semester"], ["id", "credits"]),
    oracle("select program, code, year, semester, id, credits from (select *, row_number() over (partition by program, code, year, semester order by id) as r from plan_item where id % 2 = 0 or id % 3 = 0) where r = 1"),
)
add(
    "s4_verified_documents",
    lambda s, d: load.verified(
        table(s, d, "documents").select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.col("text").alias("content")),
        table(s, d, "documents").select(F.concat(F.lit("docs\\"), "doc_id").alias("path"), F.when(F.col("doc_id") % 10 == 0, F.sha2("source", 256)).otherwise(F.upper(F.sha2("text", 256))).alias("sha256")),
    ).select("path", "sha256"),
    "select 'docs/' || doc_id as path, sha256(text) as sha256 from documents where doc_id % 10 <> 0",
)
add(
    "s3_merge_sources",
    lambda s, d: load.merge_sources(roles.plan_item(s, d).selectExpr("program", "code", "track", "id", "type as source"), ["program", "code"], ["track", "id"], "source"),
    oracle("select program, code, arg_min(track, track * 1000000000000 + id) as track, arg_min(id, track * 1000000000000 + id) as id, arg_min(type, track * 1000000000000 + id) as source, list_sort(list_distinct(list(type))) as sources from plan_item group by program, code"),
)
add(
    "s5_replace_programs",
    lambda s, d: load.replace_programs(roles.plan_item(s, d).select("program", "track", "code", "credits", "id"), roles.plan_item(s, d).filter("program in ('P1', 'P3') and track = 0 and id % 2 = 0").select("program", "track", "code", "credits", "id"), ["program", "track"], ["program", "track", "code"], "id"),
    oracle("select program, track, code, credits, id from plan_item where not (program in ('P1', 'P3') and track = 0) union all select program, track, code, credits, id from (select *, row_number() over (partition by program, code order by id desc) as r from plan_item where program in ('P1', 'P3') and track = 0 and id % 2 = 0) where r = 1"),
)
def _loaded(s, d):
    """All programs, then some of them again in part, read back from files; the second load runs twice."""
    rows = roles.plan_item(s, d).select("program", "track", "code", "credits", "id")
    path = shared_path(s, "plans")
    load.load_programs(rows, path, ["program", "track"], ["program", "track", "code"], "id")
    for _ in range(2):
        load.load_programs(rows.filter("program in ('P1', 'P3') and track = 0 and id % 2 = 0"), path, ["program", "track"], ["program", "track", "code"], "id")
    return s.read.schema(rows.schema).parquet(path)


def _upserted(s, d):
    rows = roles.plan_item(s, d).select("program", "code", "credits", "id")
    path = shared_path(s, "courses")
    load.load_upsert(rows.filter("id % 2 = 0"), path, ["program"], ["code"], "id")
    for _ in range(2):
        load.load_upsert(rows.filter("id % 2 = 1 and program <> 'P2'").withColumn("credits", F.col("credits") + 100), path, ["program"], ["code"], "id")
    return s.read.schema(rows.schema).parquet(path)


add(
    "s5_load_programs",
    _loaded,
    oracle("select program, track, code, credits, id from (select *, row_number() over (partition by program, track, code order by id desc) as r from plan_item where not (program in ('P1', 'P3') and track = 0 and id % 2 = 1)) where r = 1"),
)
add(
    "s5_load_upsert",
    _upserted,
    oracle("select program, code, case when id % 2 = 1 then credits + 100 else credits end as credits, id from (select *, row_number() over (partition by program, code order by id % 2 desc, id desc) as r from plan_item where id % 2 = 0 or program <> 'P2') where r = 1"),
)
add(
    "s5_upsert",
    lambda s, d: load.upsert(roles.plan_item(s, d).select("program", "code", "credits", "id"), ["program", "code"], "id"),
    oracle("select program, code, credits, id from (select *, row_number() over (partition by program, code order by id desc) as r from plan_item) where r = 1"),
)
add(
    "s6_insert_if_absent",
    lambda s, d: load.insert_if_absent(roles.course(s, d).filter("lab_h = 0"), roles.course(s, d).filter("lecture_h < 2"), ["code"])[0].select("code", F.lit("added").alias("what")).unionByName(
        load.insert_if_absent(roles.course(s, d).filter("lab_h = 0"), roles.course(s, d).filter("lecture_h < 2"), ["code"])[1].select("code", F.lit("conflict").alias("what"))
    ),
    oracle("select code, case when lab_h = 0 then 'conflict' else 'added' end as what from course where lecture_h < 2"),
)
RULES = {"year": "year between 1 and 3", "credits": "credits <= 5"}
add(
    "s7_quarantine",
    lambda s, d: load.quarantine(roles.plan_item(s, d).select("program", "id", "code", "year", "semester", "credits"), {k: F.expr(v) for k, v in RULES.items()}, ["program", "code", "year", "semester"], roles.course(s, d))[1].select(
        "id", F.array_join("reasons", ",").alias("reasons")
    ),
    oracle(
        ", q as (select id, case when year > 3 then 'year' end as a, case when credits > 5 then 'credits' end as b, case when count(*) over (partition by program, code, year, semester) > 1 then 'unique' end as c, case when code not in (select code from course) then 'foreign key' end as f from plan_item) select id, concat_ws(',', a, b, c, f) as reasons from q where coalesce(a, b, c, f) is not null"
    ),
)
add(
    "s9_pack_records",
    lambda s, d: load.pack_records(roles.plan_item(s, d).filter("alt_group is not null"), ["program", "edition", "track", "alt_group"], ["code", "credits"], ["id"]),
    oracle("select program, edition, track, alt_group, '[' || string_agg('{\"code\":\"' || code || '\",\"credits\":' || credits || '}', ',' order by id) || ']' as records, count(*) as n from plan_item where alt_group is not null group by all"),
)
add(
    "s10_catalog_priority",
    lambda s, d: load.merge_first(roles.plan_item(s, d).withColumn("priority", F.expr("case when edition = 1 then 0 else 1 end")).select("code", "priority", "program", "id"), ["code"], ["priority", "program", "id"]),
    oracle("select code, priority, program, id from (select code, 1 - edition as priority, program, id, row_number() over (partition by code order by 1 - edition, program, id) as r from plan_item) where r = 1"),
)

NAMES = "select p_partkey, p_name as a, case when p_partkey % 7 = 0 then substring(p_name, 2) when p_partkey % 5 = 0 then p_brand else p_name end as b from part"


def pairs(s, d):
    return table(s, d, "part").selectExpr("p_partkey", "p_name as a", "case when p_partkey % 7 = 0 then substring(p_name, 2) when p_partkey % 5 = 0 then p_brand else p_name end as b")


add(
    "a1_edit_counts",
    lambda s, d: evaluate.with_edits(pairs(s, d), "a", "b").selectExpr("p_partkey", "distance", "sub + del + ins as total", "del - ins as difference"),
    f"select p_partkey, cast(levenshtein(a, b) as int) as distance, cast(levenshtein(a, b) as int) as total, cast(length(a) - length(b) as int) as difference from ({NAMES})",
)
add(
    "a2_cer",
    lambda s, d: pairs(s, d).select("p_partkey", F.round(evaluate.error_rate(F.levenshtein("a", "b"), F.length("a"), F.length("b")), 6).alias("cer")),
    f"select p_partkey, round(case when length(a) > 0 then levenshtein(a, b) / length(a) when length(b) > 0 then 1.0 else 0.0 end, 6) as cer from ({NAMES})",
)
#: Names in other cases and with spaces, or cut or missing; brands missing in the truth.
READ_NAME = "case when p_partkey % 7 = 0 then substring(p_name, 2) when p_partkey % 3 = 0 then upper(p_name) || '  ' when p_partkey % 5 > 0 then p_name end"


def _stats(s, d):
    return evaluate.field_stats(table(s, d, "part").selectExpr("p_partkey", "p_name as truth_name", f"{READ_NAME} as pred_name", "case when p_size % 3 > 0 then p_brand end as truth_brand", "p_brand as pred_brand"), ["name", "brand"], key="p_partkey")


STATS = f"""e as (select 'name' as field, replace(lower(p_name), ' ', '') as r, coalesce(replace(lower({READ_NAME}), ' ', ''), '') as h from part union all select 'brand', coalesce(case when p_size % 3 > 0 then lower(p_brand) end, ''), lower(p_brand) from part),
f as (select field, count(*) as items, cast(count_if(r = h) as bigint) as exact, cast(count_if(r <> '' and h = '') as bigint) as missing, cast(count_if(r = '' and h <> '') as bigint) as hallucinated, cast(sum(levenshtein(r, h)) as bigint) as errors, cast(sum(length(r)) as bigint) as ref_length from e group by field),
g as (select *, round(cast(errors as double) / ref_length, 6) as cer from f)"""
add("a3_field_stats", lambda s, d: _stats(s, d).select("field", "items", "exact", "missing", "hallucinated", "errors", "ref_length", "cer"), f"with {STATS} select * from g")
add(
    "a3_overall",
    lambda s, d: evaluate.overall(_stats(s, d)).select("items", "exact", "errors", "ref_length", "macro_cer", "macro_exact", "micro_cer", "micro_exact"),
    f"with {STATS} select cast(sum(items) as bigint) as items, cast(sum(exact) as bigint) as exact, cast(sum(errors) as bigint) as errors, cast(sum(ref_length) as bigint) as ref_length, round(avg(cer), 6) as macro_cer, round(avg(exact / items), 6) as macro_exact, round(sum(errors) / sum(ref_length), 6) as micro_cer, round(sum(exact) / sum(items), 6) as micro_exact from g",
)


def truth(s, d):
    return roles.plan_item(s, d).filter("id % 4 < 3").withColumn("ordinal", F.col("id"))


def prediction(s, d):
    return roles.plan_item(s, d).filter("id % 4 > 0").withColumn("ordinal", F.col("id"))


add(
    "a4_align_by_key",
    lambda s, d: evaluate.scores(evaluate.align_by_key(truth(s, d), prediction(s, d), ["program", "code"])),
    oracle(
        """, t as (select program, code, row_number() over (partition by program, code order by id) as n, id as t_id from plan_item where id % 4 < 3), p as (select program, code, row_number() over (partition by program, code order by id) as n, id as p_id from plan_item where id % 4 > 0),
c as (select cast(count_if(t_id is not null and p_id is not null) as bigint) as matched, cast(count_if(p_id is null) as bigint) as missed, cast(count_if(t_id is null) as bigint) as spurious from t full join p using (program, code, n)), r as (select *, matched / (matched + spurious) as precision, matched / (matched + missed) as recall from c)
select *, 2 * precision * recall / (precision + recall) as f1 from r"""
    ),
)
add(
    "a5_align_multipass",
    lambda s, d: evaluate.align_multipass(truth(s, d), prediction(s, d), [["program", "code", "year"], ["program", "code"]]),
    oracle(
        """, t as (select *, row_number() over (partition by program, code, year order by id) as n from plan_item where id % 4 < 3), p as (select *, row_number() over (partition by program, code, year order by id) as n, min(id) over (partition by program, code, year) as lead from plan_item where id % 4 > 0),
a as (select t.id as t_id, p.id as p_id from t join p using (program, code, year, n)),
u as (select program, code, id, row_number() over (partition by program, code order by id) as n from t where id not in (select t_id from a)), v as (select program, code, id, row_number() over (partition by program, code order by lead, id) as n from p where id not in (select p_id from a))
select 0 as pass, t_id, p_id from a union all select case when u.id is null or v.id is null then 2 else 1 end, u.id, v.id from u full join v using (program, code, n)"""
    ),
)
add(
    "a7_evaluate_fields",
    lambda s, d: evaluate.evaluate_fields(
        load.merge_first(truth(s, d), ["program", "code"], ["id"]).withColumns({"semester": F.expr("case when id % 3 = 0 then 0 else semester end"), "credits": F.expr("credits || '(1-2-3)'")}),
        load.merge_first(prediction(s, d), ["program", "code"], ["id"]).withColumns({"credits": F.expr("case when id % 5 = 0 then null when id % 7 = 0 then credits || '(9-9-9)' else '' || credits end"), "semester": F.expr("case when id % 3 > 0 then semester end")}),
        ["program", "code"], ["code", "credits", "category", "semester"],
    ).drop("examples"),
    oracle(
        """, t as (select * from (select *, row_number() over (partition by program, code order by id) as r from plan_item where id % 4 < 3) where r = 1), p as (select * from (select *, row_number() over (partition by program, code order by id) as r from plan_item where id % 4 > 0) where r = 1),
e as (select unnest(['code', 'category', 'semester', 'credits']) as field, unnest([case when t.id is null then '' else '1' end, coalesce(t.category, ''), case when t.id is null or t.id % 3 = 0 then '' else '' || t.semester end, case when t.id is null then '' else '' || t.credits end]) as t, unnest([case when p.id is null then '' else '1' end, coalesce(p.category, ''), case when p.id is null or p.id % 3 = 0 then '' else '' || p.semester end, case when p.id is null or p.id % 5 = 0 then '' when p.id % 7 = 0 then p.credits || '(9-9-9)' else '' || p.credits end]) as p from t full join p using (program, code)),
f as (select field, cast(count_if(t = p and t <> '') as bigint) as tp, cast(count_if(t <> p and p <> '') as bigint) as fp, cast(count_if(t <> p and t <> '') as bigint) as fn from e group by field), u as (select * from f union all select 'all', cast(sum(tp) as bigint), cast(sum(fp) as bigint), cast(sum(fn) as bigint) from f), g as (select *, 2 * tp / (2 * tp + fp + fn) as x from u)
select field, tp, fp, fn, round(x, 6) as f1, case when x > 0.91 then 'high' when x >= 0.8 then 'fair' else 'low' end as band from g"""
    ),
)
def _answers(s, d):
    p = roles.plan_item(s, d)
    expected = p.groupBy("program", "edition", "track", "year").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count("*").alias("n")).selectExpr(
        "program || edition || track || year as question",
        "case year when 1 then 'value' when 2 then 'set' when 3 then 'count' else 'none' end as type",
        "case year when 1 then array(lo) when 2 then array(lo, hi, case when track = 1 then 'absent' else lo end) when 3 then array('' || n) else array() end as value",
    )
    got = p.selectExpr("program || edition || track || year as question", "code as value").filter("substring(question, 4, 1) <> '0' or substring(question, -1) <> '4'")
    return evaluate.score_answers(expected, got)


add(
    "a8_score_answers",
    _answers,
    oracle(
        "select program || edition || track || year as question, case year when 1 then 'value' when 2 then 'set' when 3 then 'count' else 'none' end as type, case year when 1 then true when 2 then track = 0 when 3 then true else track = 0 end as correct from plan_item group by program, edition, track, year"
    ),
)
add(
    "a9_score_summary",
    lambda s, d: evaluate.score_summary(table(s, d, "orders").selectExpr("o_orderstatus as level", "o_orderkey % 11 > 0 as executed", "o_orderkey % 5 as n_rows", "o_orderkey % 3 as n_pages", "o_orderkey % 2 = 0 as correct"), ["level"]),
    """with a as (select o_orderstatus as level, o_orderkey as k from orders)
select level, count(*) as n, cast(count_if(k % 11 > 0) as bigint) as n_executed, cast(count_if(k % 2 = 0) as bigint) as n_correct, cast(count_if(k % 5 > 0) as bigint) as n_answerable, cast(count_if(k % 5 > 0 and k % 3 > 0) as bigint) as n_cited,
round(count_if(k % 11 > 0) / count(*), 6) as executed_rate, round(count_if(k % 2 = 0) / count(*), 6) as rate, round(count_if(k % 5 > 0 and k % 3 > 0) / count_if(k % 5 > 0), 6) as cited_rate from a group by rollup (level)""",
)


def _metrics(s, d):
    path = shared_path(s, "metrics")
    made = roles.plan_item(s, d).groupBy("program", "category").agg(F.count("*").alias("n"), F.round(F.avg("credits"), 6).alias("mean"))
    convert.write_metrics(made, path)
    return s.read.option("header", True).schema("program string, category string, n long, mean double").csv(path)


add("s8_write_metrics", _metrics, oracle("select program, category, count(*) as n, round(avg(credits), 6) as mean from plan_item group by all"))


def _reports(s, d):
    """Reports and manifest, written twice, read back and laid out as rows."""
    rows = roles.plan_item(s, d).select("program", "category", "code", "credits", "year")
    checks = rows.groupBy("program", "category").agg(F.count_if(F.col("credits") == 0).alias("n"))
    scores = rows.filter("program <> 'P2'").groupBy("program", "year").agg(F.sum("credits").alias("credits"))
    report, listed = load.nested_report({"checks": checks, "scores": scores}, ["program"]), load.manifest({"plan": rows, "second": rows.filter("year = 2")}, ["program"])
    path = shared_path(s, "reports")
    load.write_reports(report, listed, path, ["program"])
    load.write_reports(report.filter("program = 'P1'"), listed.filter("program = 'P1'"), path, ["program"])
    back, marks = load.read_reports(s, f"{path}/report", report), load.read_reports(s, f"{path}/manifest", listed)
    return (
        back.select("program", F.explode("checks").alias("x")).selectExpr("program", "'check' as part", "x.category as name", "x.n as value")
        .unionByName(back.select("program", F.explode("scores").alias("x")).selectExpr("program", "'score' as part", "'' || x.year as name", "x.credits as value"))
        .unionByName(back.selectExpr("program", "'scores' as part", "'' as name", "cast(size(scores) as long) as value"))
        .unionByName(marks.selectExpr("program", "input as part", "'rows' as name", "n_rows as value")).unionByName(marks.selectExpr("program", "input as part", "'mark' as name", "mark as value"))
    )


add(
    "s8_nested_report",
    _reports,
    oracle(
        """, m as (select program, year, cast('0x' || substr(sha256(program || '|' || category || '|' || code || '|' || coalesce('' || credits, '\\N') || '|' || year), 1, 8) as bigint) as h from plan_item)
select program, 'check' as part, category as name, cast(count_if(credits = 0) as bigint) as value from plan_item group by all
union all select program, 'score', '' || year, cast(sum(credits) as bigint) from plan_item where program <> 'P2' group by program, year
union all select program, 'scores', '', cast(case when program = 'P2' then 0 else count(distinct year) end as bigint) from plan_item group by program
union all select program, 'plan', 'rows', count(*) from m group by program union all select program, 'plan', 'mark', cast(sum(h) as bigint) from m group by program
union all select program, 'second', 'rows', count(*) from m where year = 2 group by program union all select program, 'second', 'mark', cast(sum(h) as bigint) from m where year = 2 group by program"""
    ),
)
