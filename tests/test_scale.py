"""Plans that hold at size: rows are dealt out before texts are made of them, and exploded tables aren't broadcast by an estimate."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plantables.sources.roles import spread

SMOKE = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return __spark_entry__.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_rows(spark):
    narrow = spark.range(0, 1000, 1, 1)
    assert spread(narrow, "id", rows=10).rdd.getNumPartitions() == 100
    assert spread(narrow, "id").rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["r15_shared_credits", "r20_codeless_rows", "r21_or_rows", "r22_split_merged_cells", "t5_table_terms", "t8_alt_groups"])
def test_exploded_tables_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["r20_codeless_rows", "t5_table_terms", "t6_skipped_tables", "t7_rowspan_groups", "t10_drop_repeated", "d2_long_heads", "d2_parse_listed", "d2_head_roles"])
def test_rows_are_dealt_before_texts_are_made(spark, name):
    assert "Exchange hashpartitioning(o_orderkey" in plan_of(spark, name)


def test_pieces_of_names_are_not_broadcast(spark):
    joins = [line for line in plan_of(spark, "t14_code_by_name").splitlines() if "Join" in line and "__key" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_c11_report_tells_terms_above_the_bound(spark, tmp_path):
    """A term of 120,000 credits, as tables of 36 million items have."""
    import duckdb

    from tests.compare import TABLES, compare

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMOKE}/{t}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    one = f"(select * replace (6.0 as l_quantity, 0.0 as l_discount) from '{SMOKE}/lineitem.parquet' where l_linenumber = 1 limit 1)"
    duckdb.sql(f"copy (select x.* replace (x.l_orderkey + 240 * i.range as l_orderkey) from {one} x, range(20000) i) to '{tmp_path}/lineitem.parquet'")
    assert compare(spark, str(tmp_path), __spark_entry__.queries()["c11_report"], __spark_entry__.oracle_sql()["c11_report"]) is None
    assert "above" in {x.detail.split("; ")[0] for x in __spark_entry__.queries()["c11_report"](spark, str(tmp_path)).collect()}


def test_lines_are_read_for_what_is_asked(spark):
    """A window for each frame of lines, and a format for each line, cost more than the rest: none for lists that aren't asked for."""
    plan = plan_of(spark, "d2_long_heads")
    assert "lag(" not in plan and "format_string" not in plan


def test_digits_that_are_none_or_too_many_are_null(spark):
    from plantables.functions.text import digits_as

    rows = spark.createDataFrame([("12",), ("",), ("99999999999",), (None,)], "x string").select(digits_as(F.col("x"))).collect()
    assert [r[0] for r in rows] == [12, None, None, None]


def test_cells_of_one_code_or_none_are_not_cut(spark):
    """Cutting a cell takes some ten patterns, in a lambda that isn't compiled: only for cells that neither are one code nor without any."""
    from plantables.functions.text import split_code_alternatives

    cells = {"12345678": ["12345678"], "12345678\n": ["12345678"], " 12345678": ["12345678"], "12345678 9": ["12345678"], "๑๒๓๔๕๖๗๘": ["12345678"], "123456789": [], "xxxxxx": ["xxxxxxxx"], "0602XXXX": ["0602xxxx"], "name or": [], "": [], None: [], "12345678 or\n87654321": ["12345678", "87654321"]}
    df = spark.createDataFrame([(x,) for x in cells], "x string").select("x", split_code_alternatives(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cells
    told = df._jdf.queryExecution().executedPlan().toString()
    assert -1 < told.find("{8}\\z") < told.find("split(")


def test_spans_of_many_columns_reach_the_next_rows():
    """Results that the faster grid must keep: spans of all columns over rows with fewer cells of their own, and one too many."""
    from plantables.operators.pages import grid

    wide = 300
    table = "<table><tr>" + f"<td rowspan={wide}>a  b</td>" * wide + "</tr>" + "<tr></tr><tr><td></td></tr>" + "</table>"
    rows = grid(table)
    assert [r["cells"] for r in rows] == [["a b"] * wide, ["", *["a b"] * (wide - 1)]]
    assert [r["origin"][:2] for r in rows] == [[0, 0], [1, 0]] and [r["inherited"][:2] for r in rows] == [[False, False], [False, True]]


def test_merged_cells_are_read_in_one_pass(spark):
    """Three readings of the rows, and a grouping of lines that stand in one row, took most of t4_normalize_rows."""
    plan = plan_of(spark, "t4_normalize_rows")
    assert plan.count("FileScan") == 1 and "Union" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("name", ["a5_align_multipass", "a6_evaluate_extraction"])
def test_alignment_reads_each_side_once(spark, name):
    """Left-overs come from each pass's full join: no anti joins, first appearances or fields joined back."""
    plan = plan_of(spark, name)
    assert "LeftAnti" not in plan and plan.count("lineitem.parquet") == 0


def test_closure_takes_several_steps_a_round(spark, monkeypatch):
    """A chain of 40 with a cycle at its end took a round, and a reading of all earlier ones, for each of its steps."""
    from plantables.operators import graph

    made = []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, what: made.append(what) or written(df, what))
    pairs = [(i, i + 1) for i in range(40)] + [(40, 37), (5, 12), (100, 5)]
    edges = spark.createDataFrame([(f"{a:03}", f"{b:03}", "pre") for a, b in pairs], "code string, requires string, kind string")
    wanted, more = set(pairs), True
    while more:
        more = {(a, d) for a, b in wanted for c, d in pairs if b == c} - wanted
        wanted |= more
    got = graph.closure(edges, edges.select("code").distinct()).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"{a:03}", f"{b:03}") for a, b in wanted)
    assert len(made) < 15


def test_canonical_texts_stay_in_arrow():
    """Texts as Python's, for a whole batch at once, took most of a worker's memory."""
    import pyarrow as pa

    from plantables.functions.text import TEXTS, canonical

    given = ["Ａﬁ ẞ", None, ""] * TEXTS
    assert canonical.func(pa.array(given)).to_pylist() == ["afi ss", None, ""] * TEXTS
    assert canonical.func(pa.array([], pa.string())).to_pylist() == []


def test_sorted_tasks_grow_with_the_rows(spark, monkeypatch):
    """Plan items were sorted in as many tasks as the session says, whatever the table's size; r15's were joined so too."""
    from plantables.sources import roles

    count = lambda name: plan_of(spark, name).count("REPARTITION_BY_NUM")
    assert count("r25_post_clean") == count("r15_repair_credits") == 0
    monkeypatch.setattr(roles, "SORTED_ROWS", 100)
    assert roles.plan_item(spark, SMOKE).rdd.getNumPartitions() == -(-roles.table(spark, SMOKE, "lineitem").count() // 100)
    assert count("r25_post_clean") > 0 and count("r15_repair_credits") == 2
