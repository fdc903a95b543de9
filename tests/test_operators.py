"""Operators on small inline rows: what they change, and what they must leave alone."""

import random

import pytest
from pyspark.sql import functions as F

from plantables.functions import text
from plantables.operators import cite, evaluate, graph, load, pages, query, repair, spans

SCOPE = ("P", 1, 0)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "pre"), ("b", "c", "pre"), ("c", "a", "pre"), ("c", "d", "co"), ("x", "x", "pre")], "code string, requires string, kind string")
    seeds = spark.createDataFrame([("a",), ("x",), ("none",)], "code string")
    assert rows(graph.closure(edges, seeds), "seed", "code") == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")]
    assert rows(graph.closure(edges, seeds, back=True), "seed", "code") == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")]
    assert rows(graph.dedupe_edges(edges.union(edges)), "code", "requires") == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]


def test_edit_counts_add_up():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(2))
        d, s, x, y = evaluate.edits(a, b)
        assert d == s + x + y and x - y == len(a) - len(b)
        assert evaluate.edits(a, a) == (0, 0, 0, 0)
    assert evaluate.edits("kitten", "sitting") == (3, 2, 0, 1)
    assert evaluate.edits("a b c".split(), "a c".split()) == (1, 0, 1, 0)


def test_word_functions(spark):
    df = spark.createDataFrame([("Foo_bar foo-Bar",), ("ＦＯＯ BAR",), ("foobar",), (None,)], "x string")
    got = df.select(text.whole_word(F.col("x"), "foo").alias("a"), text.whole_word(F.col("x"), "").alias("b"), text.contains_ignoring_space(F.col("x"), "o b").alias("c"), text.canonical("x").alias("d")).collect()
    assert [r.a for r in got] == [1, 1, 0, 0]
    assert {r.b for r in got} == {0}
    assert [r.c for r in got] == [0, 1, 1, 0]
    assert got[1].d == "foo bar"


def test_credits(spark):
    df = spark.createDataFrame([("3(2-2-5)",), (" 3 ( x-0-6 ) ",), ("7",), ("13",), ("abc",), (None,)], "x string")
    got = df.select(text.parse_credits(F.col("x")).alias("c")).select("c.*").collect()
    assert [(r.credits, r.lecture, r.error) for r in got] == [(3, 2, False), (3, None, False), (7, None, False), (None, None, True), (None, None, True), (None, None, False)]
    same = spark.createDataFrame([("3(2-2-5)", "3 (2-2-5)"), ("3", "3(2-2-5)"), ("3(3-0-6)", "3(2-2-5)"), (None, "")], "a string, b string").select(text.credits_match(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in same] == [True, True, False, True]


def test_grid_carries_row_spans():
    html = '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td rowspan=3>d</td></tr><tr><td>e</td></tr></table>'
    assert [(r["cells"], r["inherited"]) for r in pages.grid(html)] == [(["a", "b", "b"], [False] * 3), (["a", "c", "d"], [True, False, False]), (["e", "", "d"], [False, False, True])]
    assert pages.grid("") == [] and pages.grid(None) == []


def test_pages_by_either_mark_and_none(spark):
    docs = spark.createDataFrame([(1, "head\n<!-- PDF_PAGE 4 -->\na\n<!-- PDF_PAGE 5 -->\nb"), (2, "--- Page 2 ---\nx"), (3, "a\n---\nb"), (4, None)], "doc_id long, text string")
    assert rows(load.split_pages(docs), "doc_id", "page_no", "text") == sorted([(1, None, "head"), (1, 4, "a"), (1, 5, "b"), (2, 2, "x"), (3, None, "a"), (3, None, "b")], key=repr)


def test_truth_shapes(spark):
    files = spark.createDataFrame([("a", '[{"code":"1"}]'), ("b", '{"courses":[{"code":"2","year":1}]}'), ("c", '{"rows":[{"code":"3"}]}'), ("d", '{"44":{"name_en":"x"}}')], "path string, text string")
    assert rows(load.read_truth(files), "path", "code", "name_en") == [("a", "1", None), ("b", "2", None), ("c", "3", None), ("d", "44", "x")]


def test_model_output(spark):
    df = spark.createDataFrame([('<think>{"a":1}</think>```json\n{"b": {"c": 2}} trailing```',), ("no",), (None,), ("{bad {\"x\": 1}",)], "x string")
    assert [r.y for r in df.select(pages.first_json("x").alias("y")).collect()] == ['{"b": {"c": 2}}', "{}", "{}", '{"x": 1}']


def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    listed = spark.createDataFrame([("a",)], "y string")
    assert rows(query.not_in(df, "x", listed, "y"), "x") == [("b",)]
    assert rows(query.not_in(df, "x", listed.union(spark.createDataFrame([(None,)], "y string")), "y"), "x") == []
    assert query.not_in(df, "x", listed.limit(0), "y").count() == 3
    with pytest.raises(ValueError):
        query.compare(df, "edition", 1, 1, [])


def test_alignment_is_first_in_first_out(spark):
    t = spark.createDataFrame([(1, "k", "p"), (2, "k", "q"), (3, "m", "r")], "ordinal long, k string, l string")
    p = spark.createDataFrame([(7, "k", "p"), (8, "k", "z"), (9, "k", "q"), (10, None, "r")], "ordinal long, k string, l string")
    assert rows(evaluate.align_by_key(t, p, ["k"]), "t_id", "p_id") == sorted([(1, 7), (2, 8), (None, 9), (3, None), (None, 10)], key=repr)
    assert rows(evaluate.align_multipass(t, p, [["k", "l"], ["l"]]), "pass", "t_id", "p_id") == sorted([(0, 1, 7), (0, 2, 9), (1, 3, 10), (2, None, 8)], key=repr)


def test_repairs_leave_doubtful_rows(spark):
    df = spark.createDataFrame([("00000001", 3), ("00000002", 3), ("00000003", None), ("00000004", 3), ("00000005", 4), ("00000006", None)], "code string, credits int")
    got = {r.code: r.credits for r in repair.impute_from_neighbours(df).collect()}
    assert got["00000003"] is None and got["00000006"] is None  # 3, 3, 3, 4 and 3, 4 don't agree
    same = df.withColumn("credits", F.when(F.col("credits").isNotNull(), 3))
    assert {r.code: r.credits for r in repair.impute_from_neighbours(same).collect()}["00000003"] == 3
    known = spark.createDataFrame([("long enough name", "12345678"), ("short", "1"), ("twice the name", "1"), ("twice the name", "2")], "name string, code string")
    asked = spark.createDataFrame([(" 1 3 ", "the long  enough name"), ("0603XXXX", "long enough name"), ("1357", "long enough name"), ("91", "long enough name"), (None, "short"), (None, "twice the name")], "code string, name string")
    assert sorted((r.name, r.code or "", r.recovered) for r in repair.recover_codes(asked, known).collect()) == [
        ("long enough name", "0603XXXX", False), ("long enough name", "12345678", True), ("long enough name", "91", False), ("short", "", False), ("the long  enough name", "12345678", True), ("twice the name", "", False),
    ]


def test_requirements_are_three_valued(spark):
    nodes = spark.createDataFrame([("a", "t", "all_of"), ("b", "t", "all_of"), ("t", None, None)], "node string, parent string, op string")
    leaves = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "a", False), (2, "b", None), (3, "a", True), (3, "b", True)], "student long, node string, value boolean")
    assert rows(cite.evaluate_requirements(leaves, nodes), "student", "value") == [(1, None), (2, False), (3, True)]


def test_partition_count_does_not_matter(spark):
    df = spark.range(500).selectExpr("cast(id % 7 as string) as code", "id as ordinal", "cast(id % 13 as int) as v")
    one, many = (rows(repair.dedupe_fill(df.repartition(n), ["code"], ["v"]), "code", "ordinal", "v") for n in (1, 8))
    assert one == many


def traced(ref, hyp):
    """Counts by a whole table and a way back: match, then substitution, then deletion, then insertion."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            d[i][j] = d[i - 1][j - 1] if ref[i - 1] == hyp[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    i, j, s, x, y = len(ref), len(hyp), 0, 0, 0
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j, s = i - 1, j - 1, s + 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            i, x = i - 1, x + 1
        else:
            j, y = j - 1, y + 1
    return d[len(ref)][len(hyp)], s, x, y


def test_edit_counts_take_ties_in_order():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        assert evaluate.edits(a, b) == traced(a, b), (a, b)


def test_field_stats_count_edits_words_and_samples(spark):
    rng = random.Random(3)
    names = [" ".join("".join(rng.choices("abAB ", k=4)) for _ in range(rng.randint(0, 3))) for _ in range(80)]
    pairs = list(zip(range(40), names[::2], names[1::2], strict=True))
    df = spark.createDataFrame([*pairs, (40, None, "x"), (41, "same  Name", "SAME name")], "id int, truth_name string, pred_name string")
    got = evaluate.field_stats(df, ["name"], words=["name"], key="id").first()
    strict, word = (lambda t: "".join((t or "").lower().split())), (lambda t: (t or "").lower().split())
    want, wrong, n_words = [0] * 4, 0, 0
    for r in df.collect():
        want = [a + b for a, b in zip(want, traced(strict(r.truth_name), strict(r.pred_name)), strict=True)]
        wrong += traced(word(r.truth_name), word(r.pred_name))[0]
        n_words += len(word(r.truth_name))
    assert [got.errors, got["sub"], got["del"], got["ins"]] == want and (got.word_errors, got.ref_words) == (wrong, n_words)
    assert got.wer == round(wrong / n_words, 6) and len(got.samples) == 5 and got["items"] == 42
    missed = df.withColumn("gone", F.col("id") < 10)
    assert evaluate.field_stats(missed, ["name"], missed="gone", exempt=["name"]).first()["items"] == 32


def test_broken_table_headers_and_long_spans():
    assert [r["cells"] for r in pages.grid("<tr><th rowspan=2>Code<td>Name</td><td>Credits</td></th></tr><tr><td>1</td><td>a&nbsp;b</td><td>3</td></tr>")] == [["Code", "Name", "Credits"], ["1", "a b", "3"]]
    assert [r["cells"] for r in pages.grid('<tr><th colspan="2" rowspan="2"><td>Code</td><td>Name</td></th></tr>')] == [["Code", "Name"]]
    spans = "<tr><td rowspan='3'>a</td><td>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr><tr><td>X</td><td>Y</td><td>Z</td></tr>"
    assert pages.grid(spans)[2] == {"cells": ["X", "Y", "Z"], "inherited": [False] * 3, "origin": [2] * 3}


def test_mentions_in_several_passes(spark):
    texts = spark.createDataFrame([(1, "the big MIT License and licenses, MIT license"), (2, None), (3, "no hit")], "id long, text string")
    lexicon = spark.createDataFrame([("MIT License", "a"), ("license", "b"), ("License", "c"), ("big MIT", "d"), ("the", "e")], "alias string, code string")
    one, many = (rows(cite.match_mentions(texts, lexicon, part=n), "id", "start", "end", "alias", "code", "codes") for n in (100, 1))
    assert one == many and [(r[3], r[4]) for r in one] == [("the", "e"), ("mit license", "a"), ("mit license", "a")]


def test_alike_names_are_found_wherever_they_differ(spark):
    from difflib import SequenceMatcher

    from plantables.operators import convert

    rng = random.Random(4)
    base = ["".join(rng.choices("abcde ", k=rng.randint(1, 40))).strip() or "z" for _ in range(60)]
    asked = []
    for name in base:
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            letters[rng.randrange(len(letters))] = rng.choice("abcdexyz")
        asked.append("".join(letters))
    named = spark.createDataFrame([(0, f"{i:08d}", n) for i, n in enumerate(base)], "doc_id int, code string, name string")
    df = spark.createDataFrame([(0, i, "PLACEHOLDER_X", n) for i, n in enumerate(asked)], "doc_id int, id int, code string, name string")
    got = {r.id: r.code for r in convert.code_by_name(df, named).collect()}
    for i, name in enumerate(asked):
        scores = [(SequenceMatcher(None, name, n, autojunk=False).ratio(), -k) for k, n in enumerate(base)]
        best = max(scores)
        assert got[i] == (f"{-best[1]:08d}" if best[0] >= 0.9 else "PLACEHOLDER_X"), (name, got[i])


def test_rows_meet_merged_cells_once(spark, monkeypatch):
    """Rows are read for one join with all that cells ask, and for their changes; what several rows of a code say must agree."""
    rows = spark.range(1, 9).selectExpr("'d' as doc_id", "cast(id as int) as ordinal", "cast(elt(id, 1, 1, 2, 5, 5, 5, 5, 1) as int) as page", "elt(id, '0601xxxx', '22222222', '0602xxxx', '22222222', '0601xxxx', '0601xxxx', '22222222', '22222222') as code",
        "elt(id, 'ก 1 ข', 'ค 1', 'ค 1', 'ข', 'ก 1', 'ก 1', 'ข', 'ค 1') as name", "cast(null as string) as name_en", "if(id in (5, 6), '3(3-0-6) or 3(2-2-5)', '3(3-0-6)') as credits", "cast(3 as int) as year", "cast(1 as int) as semester", "if(id = 7, 'D', 'C') as category", "'core' as type", "id = 3 as inferred")
    grid = spark.createDataFrame(
        [("d", 1, 0, 0, ["0601xxxx\n22222222", "ก 1\nElective 1\n(Faculty)\nข\nModern business", "3(3-0-6)"], [False] * 3, [0] * 3), ("d", 1, 0, 1, ["0601xxxx\n22222222", "ค 1\nGeneral 1", "3(3-0-6)"], [True, False, False], [0, 1, 1])],
        "doc_id string, page_no int, table_no int, row_no int, cells array<string>, inherited array<boolean>, origin array<int>",
    )
    plans = []
    monkeypatch.setattr(spans, "written", lambda df, what, plain=spans.written: plans.append(df) or plain(df, what))
    out = spans.split_merged_cells(rows, grid, "Faculty", spark.createDataFrame([("d", 2, "other")], "doc_id string, page_no int, text string"))
    got = {r.ordinal: (r.page, r.name, r.name_en, r.credits, r.category, r.type) for r in out.filter("note is not null").collect()}
    assert got == {1: (1, "ก 1", "Elective 1", "3(3-0-6) or 3(2-2-5)", "C", "core"), 2: (1, "ข", "Modern business", "3(3-0-6)", "C", "core"), 3: (1, "ค 1", None, "3(3-0-6)", "C", "core")}
    assert sum(df._jdf.queryExecution().optimizedPlan().toString().count("Range (1, 9") for df in [*plans, out]) == 2


def test_alternative_groups_read_their_entries_once(spark):
    """Entries are made of whole tables, so they are run once; groups that follow by an "or" share one, numbered in the term."""
    entries = spark.range(8).selectExpr("'d' as doc_id", "1 as page_no", "cast(id / 6 as int) as table_no", "cast(elt(id + 1, 1, 1, 2, 3, 4, 5, 1, 1) as int) as grp", "cast(elt(id + 1, 0, 1, 0, 0, 0, 0, 0, 1) as int) as entry", "'' || id as code", "'n' as name", "'3' as credits", "id in (0, 1, 6, 7) as alternative", "id in (2, 5) as follows")
    terms = spark.createDataFrame([("d", 1, 0, 2, 1), ("d", 1, 1, 2, 1)], "doc_id string, page_no int, table_no int, year int, semester int")
    out = pages.assign_alt_groups(entries, terms)
    assert sorted((int(r.code), r.alt_group) for r in out.collect()) == [(0, "alt_y2s1_1"), (1, "alt_y2s1_1"), (2, "alt_y2s1_1"), (3, None), (4, "alt_y2s1_2"), (5, "alt_y2s1_2"), (6, "alt_y2s1_3"), (7, "alt_y2s1_3")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 8") == 1
