"""The curriculum tables, as roles that other tables play.

A role is a list of (column, SQL expression) over one source table, so that
the same definition serves Spark and an oracle. Rows are keyed by scope:
program, edition and track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE = ["program", "edition", "track"]


def _scope(key: str) -> list[tuple[str, str]]:
    return [
        ("program", f"'P' || (cast(floor({key} / 4) as bigint) % 5)"),
        ("edition", f"cast(cast(floor({key} / 20) as bigint) % 2 as int)"),
        ("track", f"cast(cast(floor({key} / 40) as bigint) % 2 as int)"),
    ]


def code_of(key: str) -> str:
    return f"case when {key} % 50 = 0 then 'PLACEHOLDER_' || lpad('' || cast(floor({key} / 50) as bigint), 5, '0') || 'XXX' else lpad('' || {key}, 8, '0') end"


COURSE = [
    ("code", code_of("p_partkey")),
    ("name_th", "p_name"),
    ("name_en", "p_name || ' ' || p_brand"),
    ("credits", "case when p_size % 17 = 0 then null else p_size % 13 end"),
    ("lecture_h", "p_size % 4"),
    ("lab_h", "p_size % 3"),
    ("self_h", "p_size % 6"),
    ("page", "cast(p_partkey % 300 + 1 as int)"),
]
PLAN_ITEM = [
    *_scope("l_orderkey"),
    ("id", "l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)"),
    ("year", "cast(l_orderkey % 4 + 1 as int)"),
    ("semester", "cast(l_linenumber % 3 + 1 as int)"),
    ("code", code_of("l_partkey")),
    ("credits", "cast(cast(l_quantity as bigint) % 7 as int)"),
    ("alt_group", "case when l_discount >= 0.05 then 'A' || l_orderkey end"),
    ("category", "l_returnflag"),
    ("type", "l_linestatus"),
    ("page", "cast(case when l_linenumber % 2 = 0 then l_partkey % 200 + 1 end as int)"),
]
PREREQUISITE = [
    ("code", "lpad('' || p_partkey, 8, '0')"),
    ("requires", "lpad('' || cast(floor(p_partkey / 2) as bigint), 8, '0')"),
    ("kind", "case when p_partkey % 3 = 0 then 'co' else 'pre' end"),
]
SLOT = [
    *_scope("l_orderkey"),
    ("code", code_of("l_partkey")),
    ("term", "(l_orderkey % 4 + 1) || '/' || (l_linenumber % 3 + 1)"),
    ("category", "l_returnflag"),
    ("credits", "cast(cast(l_quantity as bigint) % 7 as int)"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a spread table to a task.
TASK_ROWS = 20_000


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt to tasks by a key, before texts and lines are made of them.

    A file of narrow rows is read in few tasks, which would make and parse all
    texts. What is made of a key then stays together, so that grouping by it
    needs no shuffle. Tasks grow in number with the rows, not in size.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(tasks, key)


#: Narrow rows of a sorted table to a task.
SORTED_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows in tasks of SORTED_ROWS by keys that they are sorted or joined by, if those are more than the session's partitions.

    A number of partitions that stays makes tasks, and what they hold or
    spill, grow with the table. Up to it the table is left to Spark, which
    merges small partitions.
    """
    tasks = -(-rows // SORTED_ROWS)
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def _role(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*(f"{e} as {n}" for n, e in columns))


def course(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _role(table(spark, sf_dir, "part").filter("p_partkey % 97 <> 0"), COURSE)
    return df.withColumn("pages", F.array("page")).drop("page")


def plan_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    df = _role(dealt(lines, lines.count(), "l_orderkey"), PLAN_ITEM)
    return df.withColumn("pages", F.when(F.col("page").isNotNull(), F.array("page"))).drop("page")


def prerequisite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role(table(spark, sf_dir, "part").filter("p_partkey >= 1"), PREREQUISITE)


def cyclic_prerequisite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of consecutive lines of one order: a graph with cycles."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    a = lines.filter("l_linenumber = 1").selectExpr("l_orderkey", "l_partkey as x")
    b = lines.filter("l_linenumber = 2").selectExpr("l_orderkey", "l_partkey as y")
    return a.join(b, "l_orderkey").selectExpr("lpad('' || x, 8, '0') as code", "lpad('' || y, 8, '0') as requires", "'pre' as kind")


def elective_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scope and code, with its terms as sorted text."""
    lines = _role(table(spark, sf_dir, "lineitem"), SLOT)
    return lines.groupBy(*SCOPE, "code").agg(
        F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("allowed_terms"), F.min("category").alias("category"), F.max("credits").alias("credits")
    )


def _sql(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns)


#: The same roles for an oracle, as common table expressions.
CTES = f"""course as (select * exclude (page), [page] as pages from (select {_sql(COURSE)} from part where p_partkey % 97 <> 0)),
plan_item as (select * exclude (page), case when page is not null then [page] end as pages from (select {_sql(PLAN_ITEM)} from lineitem)),
prerequisite as (select {_sql(PREREQUISITE)} from part where p_partkey >= 1),
cyclic_prerequisite as (select lpad('' || a.l_partkey, 8, '0') as code, lpad('' || b.l_partkey, 8, '0') as requires, 'pre' as kind from lineitem a join lineitem b using (l_orderkey) where a.l_linenumber = 1 and b.l_linenumber = 2),
elective_slot as (select program, edition, track, code, array_to_string(list_sort(list_distinct(list(term))), ', ') as allowed_terms, min(category) as category, max(credits) as credits from (select {_sql(SLOT)} from lineitem) group by all)"""


def oracle(body: str) -> str:
    """A query over the roles; body starts with select, or with a comma and more common table expressions."""
    return f"with recursive {CTES} {body}"
