"""Rules of names, codes, tables and citations on rows made for them: nulls, ties, empty tables."""

import hashlib
import random
from difflib import SequenceMatcher
from pathlib import Path

from pyspark.sql import functions as F

from plantables.functions import text as f
from plantables.operators import changes, checks, cite, convert, load, pages, repair, spans, views
from plantables.sources import scratch


def rows_of(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_page_predicates(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "Prerequisite 12345678"), (4, "Prerequisite <table>"), (5, "123456789 xxxxxxx"), (6, "060xxx")], "id int, text string")
    got = texts.select("id", pages.is_description_page(F.col("text"), ["Prerequisite"]).alias("d"), pages.has_content(F.col("text")).alias("c"))
    assert rows_of(got, "id") == [(1, False, False), (2, False, False), (3, True, True), (4, False, True), (5, False, False), (6, False, True)]


def test_wildcards_by_slot_number(spark):
    code = "PLACEHOLDER_0602XXXX"
    rows = spark.createDataFrame(
        [("P", 1, code, "Elective"), ("P", 2, code, "Elective 1"), ("P", 3, code, "Elective 3"), ("P", 4, code, "Other"), ("P", 5, code, "Other 3"), ("P", 6, code, "Elective"), ("P", 7, code + "_9", "x"), ("P", 8, "00000001", None), ("P", 9, None, None)],
        "program string, ordinal long, code string, name string",
    )
    got = rows_of(repair.suffix_wildcards(rows, ["program"], ["name"]).select("ordinal", "code"), "ordinal")
    # 1 and 3 are asked for; what has no number of its own takes 2, 4 and 5 in order
    assert got == [(1, code + "_2"), (2, code), (3, code + "_3"), (4, code + "_4"), (5, code + "_5"), (6, code + "_2"), (7, code + "_9"), (8, "00000001"), (9, None)]


def test_slipped_codes_need_as_many_rows(spark):
    schema = "k int, pos int, code string, name string, elective boolean"
    whole = [(1, 1, "00000001", "a", False), (1, 2, "00000002", "Elective", True), (1, 3, "00000003", "b", False), (1, 4, None, "c", False)]
    short = [(2, 1, "00000002", "Elective", True), (2, 2, "00000003", "b", False), (2, 3, "00000004", "c", False), (2, 4, "00000005", "", False)]
    got = rows_of(convert.realign_codes(spark.createDataFrame(whole + short, schema), ["k"], "0602xxxx").select("k", "pos", "code"), "k", "pos")
    assert got == [(1, 1, "00000001"), (1, 2, "0602xxxx"), (1, 3, "00000002"), (1, 4, "00000003"), (2, 1, "0602xxxx"), (2, 2, "00000003"), (2, 3, "00000004"), (2, 4, "00000005")]
    assert convert.realign_codes(spark.createDataFrame([], schema), ["k"], "x").count() == 0


def test_second_names_are_never_empty(spark):
    got = spark.createDataFrame([(1, "## 3 ALGEBRA (I"), (2, "3(3-0-6)"), (3, None), (4, "")], "id int, x string").select("id", f.clean_name_secondary(F.col("x"), ["NOTE"]).alias("y"))
    assert rows_of(got, "id") == [(1, "ALGEBRA I"), (2, "3(3-0-6)"), (3, None), (4, "")]


def test_credit_digits_stay_where_the_name_is_printed_alone(spark):
    rows = spark.createDataFrame([(1, 1, "a", "SKILL 3", "3(3-0-6)"), (1, 2, "b", "WORK 3", "3(3-0-6)"), (1, 3, "c", None, None), (2, 1, "a", "SKILL 3", "3 (3-0-6)")], "doc_id int, ordinal int, code string, name_en string, credits string")
    docs = spark.createDataFrame([(1, "SKILL 3 (3-0-6) WORK 3 (3 - 0 - 6)\n**WORK  3**"), (2, None)], "doc_id int, text string")
    printed = spark.createDataFrame([], "doc_id int, code string, name_en string")
    got = rows_of(convert.strip_credit_digit(rows, docs, printed).select("doc_id", "ordinal", "name_en", "note"), "doc_id", "ordinal")
    assert got == [(1, 1, "SKILL", "credits at the end of SKILL 3"), (1, 2, "WORK 3", None), (1, 3, None, None), (2, 1, "SKILL 3", None)]


def test_numbers_of_a_series_stay_in_names(spark):
    lines = [(1, 1, "00000001 Topic 1 (1-0-2)"), (1, 2, "Prerequisite: none"), (1, 3, "00000002 Topic 2 (2-0-4)"), (1, 4, "Prerequisite: none"), (1, 5, "00000003 Alone 3 (3-0-6)"), (1, 6, "Prerequisite: none")]
    blocks = convert.description_blocks(spark.createDataFrame(lines, "doc_id int, line_no long, line string"), r"^[0-9]{8}\b", "^Prerequisite")
    got = rows_of(convert.parse_blocks(blocks).select("code", "name", "credits"), "code")
    assert got == [("00000001", "Topic 1", "1(1-0-2)"), ("00000002", "Topic 2", "2(2-0-4)"), ("00000003", "Alone", "3(3-0-6)")]


def test_aliases_are_cut_twice_and_share_codes(spark):
    course = spark.createDataFrame([("1", "หลักการพื้นฐานโปรแกรมเบื้องต้น", None), ("2", "โปรแกรม", "ab"), ("3", "พื้นฐานกข", None)], "code string, name_th string, name_en string")
    got = dict(rows_of(views.lexicon(course).select("alias", "codes"), "alias"))
    assert got == {"หลักการพื้นฐานโปรแกรมเบื้องต้น": ["1"], "พื้นฐานโปรแกรม": ["1"], "โปรแกรม": ["1", "2"], "พื้นฐานกข": ["3"]}


def test_citations_without_readable_pages_are_left_out(spark):
    evidence = spark.createDataFrame([(1, "a", None, 1, "[2, 1, 1]"), (2, "a", None, 1, "page 2"), (3, "a", 1, 1, "[1, 2]"), (4, None, None, 1, "[1, 2]"), (5, "a", None, 1, None)], "id int, code string, year int, semester int, pages string")
    plan = spark.createDataFrame([("a", None, 1, [1, 2]), (None, None, 1, [1, 2])], "code string, year int, semester int, pages array<int>")
    course = spark.createDataFrame([("a", [2, 1]), ("b", None)], "code string, pages array<int>")
    assert rows_of(cite.citations(evidence, plan, course), "id") == [(1, "plan_item", [1, 2]), (3, "course", [1, 2]), (4, "unknown", [1, 2])]


def kleene(nodes, leaves, node, seen=()):
    """A node's value: True, False, or None for unknown."""
    if node in seen:
        return None
    ops = [(child, op) for child, parent, op in nodes if parent == node]
    if not ops:
        return leaves.get(node)
    values = [kleene(nodes, leaves, child, (*seen, node)) for child, _ in ops]
    if ops[0][1] == "all_of":
        return False if False in values else True if all(values) else None
    return True if True in values else False if all(v is False for v in values) else None


def test_requirement_trees_of_any_shape(spark):
    r = random.Random(4)
    nodes, leaves = [("r0", None, None)], []
    for tree in range(12):
        own, op = [f"t{tree}"], {}
        nodes.append((own[0], None, None))
        for i in range(r.choice([1, 3, 8, 14])):
            parent = own[-1] if tree % 3 == 0 else r.choice(own)  # every third one is a chain
            op.setdefault(parent, r.choice(["all_of", "any_of"]))
            own.append(f"t{tree}n{i}")
            nodes.append((own[-1], parent, op[parent]))
        for student in range(6):
            leaves += [(student, n, r.choice([True, True, False, False, None])) for n in own if n not in op and r.random() < 0.8]
    # mixed depth, a leaf's value that children overrule, a node of two parents, a leaf that is a tree, a cycle, and what stands above one
    nodes += [("m", None, None), ("m1", "m", "all_of"), ("m2", "m", "all_of"), ("m3", "m2", "any_of"), ("m3", "m", "all_of"), ("lone", None, None), ("c1", "c2", "all_of"), ("c2", "c1", "all_of"), ("above", None, None), ("c1", "above", "any_of"), ("m1", "above", "any_of")]
    leaves += [(7, "m1", True), (7, "m2", True), (7, "m3", False), (8, "m1", True), (8, "m3", True), (8, "lone", None), (9, "lone", False)]
    tops = [n for n, parent, _ in nodes if parent is None]
    asked = [(s, t) for s in range(10) for t in tops]
    shape, given = spark.createDataFrame(nodes, "node string, parent string, op string"), spark.createDataFrame(leaves, "student long, node string, value boolean")
    wanted = sorted((s, t, kleene(nodes, {n: v for x, n, v in leaves if x == s}, t) if t != "above" else None) for s, t in asked)
    got = cite.evaluate_requirements(given, shape, spark.createDataFrame(asked, "student long, node string"))
    assert rows_of(got, "student", "node") == wanted
    held = rows_of(cite.evaluate_requirements(given, shape), "student", "node")
    assert len({x[:2] for x in held}) == len(held) and set(held) <= set(wanted) and {(7, "m", False), (8, "m", True), (9, "lone", False)} <= set(held)
    assert rows_of(cite.requirement_cycles(shape), "node") == [("above",), ("c1",), ("c2",)]
    assert cite.evaluate_requirements(given.limit(0), shape.limit(0)).count() == 0


GRID = "doc_id int, page_no int, table_no int, row_no int, cells array<string>, inherited array<boolean>, origin array<int>"


def grid_of(spark, *tables):
    rows = [(1, 1, t, n, r["cells"], r["inherited"], r["origin"]) for t, html in enumerate(tables) for n, r in enumerate(pages.grid(html))]
    return spark.createDataFrame(rows, GRID)


def test_items_of_merged_cells(spark):
    table = (
        "<tr><td>Code</td><td>Name</td><td>Credits</td></tr><tr><td>lost<br>00000001 A<br>3(3-0-6) 00000002 B 2(2-0-4)<br>Total 5<br>lost</td></tr>"
        "<tr><td rowspan=2>00000003</td><td>C</td><td>1(0-2-1)</td></tr><tr><td>D 2(2-0-4)</td></tr><tr><td></td></tr><tr><td>00000004</td><td>E</td></tr><tr><td> 6 (0-35-0) </td></tr><tr><td>Total</td><td>9</td></tr>"
    )
    got = convert.normalize_grid_rows(grid_of(spark, table))
    assert [(r.row_no, r.kind, r.cells) for r in got.orderBy("row_no").collect()] == [
        (0, "row", ["Code", "Name", "Credits"]), (1, "course", ["00000001", "A", "3(3-0-6)"]), (2, "course", ["00000002", "B", "2(2-0-4)"]), (3, "total", ["Total", "Total", "5"]),
        (4, "row", ["00000003", "C", "1(0-2-1)"]), (5, "row", ["00000003", "D 2(2-0-4)", ""]), (6, "course", ["00000004", "E", ""]), (7, "credits", ["", "", "6 (0-35-0)"]), (8, "row", ["Total", "9", ""]),
    ]
    assert convert.normalize_grid_rows(grid_of(spark)).count() == 0


def test_headings_of_tables(spark):
    texts = [
        (1, 1, "Plan co-op Year 1 Semester 1<table><tr><td>x</td></tr></table>Year 1\nSemester 2 <TABLE><tr><td>y</td></tr></TABLE><table><tr><th>Code</th></tr><tr><td>Year 9 Semester 1</td></tr></table>"),
        (1, 3, "<table><tr><th>Code, Year 3 Semester summer</th></tr></table>Plan without co-op<table><tr><td>z</td></tr></table>"), (1, 2, None), (2, 1, "<table><tr><td>x</td></tr></table>Year ๒ Semester ๑<table><tr><td>x</td></tr></table>"), (3, 1, ""),
    ]
    df = spark.createDataFrame(texts, "doc_id int, page_no int, text string")
    got = pages.table_terms(df, pages.grid_rows(pages.explode_tables(df)), r"(?i)year\s*([0-9]+)\s*semester\s*([0-9]+|summer)", r"(?i)plan (without )?co-op")
    assert rows_of(got, "doc_id", "page_no", "table_no") == [
        (1, 1, 0, 1, 1, "coop"), (1, 1, 1, 1, 2, "coop"), (1, 1, 2, 1, 2, "coop"), (1, 3, 0, 3, 3, "coop"), (1, 3, 1, 3, 3, "nocoop"), (2, 1, 0, None, None, None), (2, 1, 1, 2, 1, None),
    ]


def test_names_just_alike_enough(spark):
    r = random.Random(2)
    named = [("".join(r.choice("ab") for _ in range(r.randint(1, 12)))) for _ in range(60)]
    asked = [x[:i] + r.choice("abX") + x[i:] for x in named for i in (0, len(x) // 2)] + ["abXcdefYghi"]
    named.append("abcdefghi")
    rows = spark.createDataFrame([(1, n, "PLACEHOLDER_X", x) for n, x in enumerate(asked)], "doc_id int, id int, code string, name string")
    known = spark.createDataFrame([(1, f"{n:08d}", x) for n, x in enumerate(named)], "doc_id int, code string, name string")
    got = {r.id: r.code for r in convert.code_by_name(rows, known).collect()}
    for n, x in enumerate(asked):
        score = max((SequenceMatcher(None, x, y, autojunk=False).ratio(), -k) for k, y in enumerate(named))
        assert got[n] == (f"{-score[1]:08d}" if score[0] >= 0.9 else "PLACEHOLDER_X"), x
    assert got[len(asked) - 1] == "00000060"  # 18 of 20 characters


def test_spans_with_nothing_to_do(spark):
    rows = spark.createDataFrame([(1, 1, 1, None, None, None, None, None, None, None, None, None, None), (None, 2, None, "00000001", "x", None, "", 1, 1, None, None, "recovered", None)], "doc_id int, ordinal int, page int, code string, name string, name_en string, credits string, year int, semester int, category string, type string, alt_group string, inferred boolean")
    known, texts = rows.select("doc_id", "name", "code"), spark.createDataFrame([], "doc_id int, page_no int, text string")
    plain = grid_of(spark, "<tr><td>00000001</td><td>a</td><td>3(3-0-6)</td></tr><tr><td></td></tr>", "", "<tr><td rowspan=3>00000001 00000002</td><td>x</td></tr><tr></tr><tr><td></td></tr>")
    for grid in (grid_of(spark), plain):
        assert spans.shared_credits(grid).count() == 0
        assert spans.codeless_rows(grid, known, rows, "^Group").count() == 0
        for got in (spans.group_or_rows(rows, grid), spans.split_merged_cells(rows, grid, "Faculty", texts)):
            assert sorted(map(repr, (tuple(r)[:13] for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in rows.collect())))
    assert spans.group_or_rows(rows.limit(0), plain).count() == 0


def test_log_of_any_step(spark):
    kind = "k int, a string, b array<int>, c double"
    before = spark.createDataFrame([(1, "x", [1], 0.1), (2, None, None, None), (None, "n", [], 1e300), (4, "gone", None, None)], kind)
    after = spark.createDataFrame([(1, "x", [1, 2], 0.1), (2, "", None, None), (None, "n", [], None), (5, None, None, None), (6, "new", [None], 2.0)], kind)
    log = changes.repair_log(before, after, ["k"], "r")
    assert sorted(map(repr, map(tuple, changes.apply_log(before, log, ["k"]).collect()))) == sorted(map(repr, map(tuple, after.collect())))
    assert rows_of(log.filter("k = 2"), "k") == [(2, "changed", "a", None, "", "r")]
    assert changes.repair_log(before, before, ["k"], "r").count() == 0 and changes.repair_log(before.limit(0), after.limit(0), ["k"], "r").count() == 0
    rows, log = changes.with_log(before, [("first", lambda r: r.filter("k > 1")), ("second", lambda r: r.withColumn("a", F.lit("z")))], ["k"])
    assert rows.count() == 2 and {(r.rule, r.step, r.kind) for r in log.collect()} == {("first", 1, "dropped"), ("second", 2, "changed")}


def test_verified_files(spark, tmp_path):
    folder = tmp_path / "books" / "one"
    folder.mkdir(parents=True)
    texts = {"a.md": "<!-- PDF_PAGE 1 -->\nfirst\n<!-- PDF_PAGE 2 -->\nsecond", "b.md": "Größe", "c.md": "changed", "e.md": "unlisted"}
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8")
    sha = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    listed = [("one\\a.md", sha["a.md"].upper()), ("one/b.md", sha["b.md"]), ("one/c.md", sha["b.md"]), ("one/d.md", sha["b.md"])]
    good, bad = load.verified_files(load.read_files(spark, str(tmp_path / "books")), spark.createDataFrame(listed, "path string, sha256 string"))
    assert rows_of(good.select("path", "text"), "path") == [("one/a.md", texts["a.md"]), ("one/b.md", "Größe")]
    assert rows_of(bad, "path") == [("one/c.md", "differs"), ("one/d.md", "missing")]
    read = load.read_page_text(spark, str(folder)).filter("doc_id like '%a.md'")
    assert rows_of(read.select("page_no", "text"), "page_no") == [(1, "first"), (2, "second")]


def test_loads_leave_other_programs_alone(spark, tmp_path):
    kind, path = "program string, code string, credits int, id int", str(tmp_path / "plan")
    load.load_programs(spark.createDataFrame([("A", "1", 3, 1), ("A", "1", 4, 2), ("B", "1", 3, 3), (None, "9", 1, 4)], kind), path, ["program"], ["program", "code"], "id")
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "plan").glob("program=[!A]*/*.parquet")}
    again = spark.createDataFrame([("A", "2", 1, 5)], kind)
    for _ in range(2):
        load.load_programs(again, path, ["program"], ["program", "code"], "id")
        assert rows_of(spark.read.schema(kind).parquet(path).select("program", "code", "credits", "id"), "id") == [("B", "1", 3, 3), (None, "9", 1, 4), ("A", "2", 1, 5)]
    assert kept and {f: f.stat().st_mtime_ns for f in kept} == kept
    load.load_upsert(spark.createDataFrame([("A", "2", 7, 1), ("A", "3", 8, 2), ("C", "1", 1, 1)], kind), path, ["program"], ["code"], "id")
    assert rows_of(spark.read.schema(kind).parquet(path).filter("program in ('A', 'C')").select("program", "code", "credits"), "program", "code") == [("A", "2", 7), ("A", "3", 8), ("C", "1", 1)]


def test_scratch_tables_are_dropped(spark):
    keep = []
    with scratch.dropping(keep):
        keep.append(scratch.written(spark.range(3).toDF("x"), "kept"))
        gone = scratch.written(spark.range(3).toDF("x"), "gone").inputFiles()
    assert keep[0].count() == 3 and not any(Path(f.removeprefix("file:")).exists() for f in (x.replace("file://", "file:") for x in gone))


def test_heads_run_over_lines(spark):
    """Heads over lines with nulls, a long line and a number within a series; a document of nothing gives no row."""
    blocks = [
        ["00000001 ก SDGs", None, "SCIENCE FOR SDGS", "2(2-0-4)", "ข", "ค", "tail"], ["00000002 " + "ก" * 20, "ข" * 120, "ค"],
        ["00000003 ก 2 (2-0-4)"], ["00000004 ก 3 (3-0-6)"], ["00000005 จ 3 (3-0-6)"], ["00000006", "13 (3-0-6)"],
    ]
    rows = [(1, n, i + 1, x) for i, block in enumerate(blocks) for n, x in enumerate(block)]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, block int, line string")
    got = rows_of(convert.parse_blocks(lines, native="[ก-๛]").select("code", "name", "name_en", "credits", "description"), "code")
    assert got == [
        ("00000001", "ก SDGs", "SCIENCE FOR SDGS", "2(2-0-4)", "ข ค"),
        ("00000002", "ก" * 20, None, None, "ข" * 120 + " ค"),
        ("00000003", "ก 2", None, "2(2-0-4)", None),
        ("00000004", "ก 3", None, "3(3-0-6)", None),
        ("00000005", "จ", None, "3(3-0-6)", None),
        ("00000006", None, None, "3(3-0-6)", None),
    ]
    assert convert.parse_blocks(lines.limit(0), native="[ก-๛]").isEmpty()


def test_report_of_every_check(spark):
    """A course before what it requires, an unknown and a spoilt code, a missing program and term; another scope is clean."""
    plan = [
        ("A", 1, 0, 1, "00000001", 1, 1, 3, None), ("A", 1, 0, 2, "00000002", 1, 2, 3, None), ("A", 1, 0, 3, "bad", 2, 1, 3, None),
        ("B", 1, 0, 4, "00000001", 1, 1, 3, None), ("B", 1, 0, 5, "00000002", 1, 2, 3, None),
    ]
    plan = spark.createDataFrame(plan, "program string, edition int, track int, id long, code string, year int, semester int, credits int, alt_group string").withColumns({"category": F.lit("x"), "type": F.lit("y")})
    course = spark.createDataFrame([("00000001", 3), ("00000002", 3)], "code string, credits int")
    program = spark.createDataFrame([("B", 1, 0, 6)], "program string, edition int, track int, total_credits long")
    edges = spark.createDataFrame([("00000001", "00000002", "pre")], "code string, requires string, kind string")
    got = checks.report(checks.every_check(plan, course, program, edges, load=(3, 6), bounds=(3, 6)), plan)
    faults = {(r["program"], r["check"], r["detail"]) for r in got.filter("not ok").collect()}
    wrong = {(p, "CHK5", "00000001/00000002") for p in "AB"}
    assert faults == wrong | {("A", "CHK0", "A"), ("A", "CHK2", "bad"), ("A", "CHK3", "bad"), ("A", "CHK13", "2/2")}
    assert got.count() == 20
    assert "CHK5" not in checks.every_check(plan, course, program)
