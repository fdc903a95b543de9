"""Repairs that read which rows of a table one cell covers (R15 shared credits, R20 rows without a code, R21 "or" rows, R22 merged cells).

Grid rows are those of pages.grid_rows(): (doc_id, page_no, table_no, row_no,
cells, inherited, origin). The code column is the first. Rules join rows to
the span that covers them; nothing is read from the text again. Both sides of
a join are made of exploded tables, which are larger than Spark estimates, so
they are merged and never broadcast by that estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.operators.pages import OR_WORD
from plantables.sources.scratch import written

TABLE = ["doc_id", "page_no", "table_no"]
#: A code or wildcard alone, credits with hours, and a letter of the first script.
CODE_CELL, CREDITS, FIRST_SCRIPT = r"^([0-9]{8}|(?=.*[xX])[0-9xX]{6,12})$", r"[0-9]{1,2}\s*\(\s*[0-9xX]+\s*-\s*[0-9xX]+\s*-\s*[0-9xX]+\s*\)", r"[฀-๿]"
#: Begins with an "or".
OPENS_OR = r"(?i)^\s*(?:or|หรือ)"
#: Begins the group of a row that an earlier repair brought back.
RECOVERED = "recovered"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def _codes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{8})(?![0-9])"), F.lit(1)))


def spans(grid: DataFrame) -> DataFrame:
    """Grid rows -> (doc_id, page_no, table_no, col, first, last, text): a row for each cell and column, with the rows that it covers."""
    cell = F.posexplode(F.arrays_zip("cells", "origin")).alias("col", "x")
    return grid.select(*TABLE, "row_no", cell).filter("x.origin is not null").groupBy(*TABLE, "col", F.col("x.origin").alias("first")).agg(F.max("row_no").alias("last"), F.min("x.cells").alias("text"))


def _own(grid: DataFrame) -> DataFrame:
    """own: the cells that begin in each row, in order."""
    pairs = F.filter(F.arrays_zip("cells", "inherited", "origin"), lambda x: ~x["inherited"] & x["origin"].isNotNull())
    return grid.withColumn("own", F.transform(pairs, lambda x: x["cells"]))


def shared_credits(grid: DataFrame) -> DataFrame:
    """(doc_id, code, usable, first): the credits of a cell of two rows or more beside a cell of alternatives ("A or B") hold for each of its codes.

    The last such cell of the row counts. usable is the value where all cells
    agree, first the first one in the document.
    """
    is_choice = (F.col("col") == 0) & (F.size("codes") >= 2) & F.col("text").rlike(OR_WORD)
    is_paid = (F.col("col") > 0) & (F.col("last") > F.col("first")) & F.col("text").rlike(CREDITS)
    # written, so that tables are read once for both
    each = written(spans(grid).withColumn("codes", _codes(F.col("text"))).filter(is_choice | is_paid), "shared")
    choice = each.filter(is_choice).select(*TABLE, "first", "codes")
    paid = each.filter(is_paid).groupBy(*TABLE, "first").agg(F.max_by("text", "col").alias("credits"))
    value = _bare(F.regexp_extract("credits", f"({CREDITS})", 1))
    told = choice.join(paid.hint("merge"), [*TABLE, "first"]).select("doc_id", F.explode("codes").alias("code"), value.alias("v"), F.struct("page_no", "table_no", "first").alias("at"))
    return told.groupBy("doc_id", "code").agg(F.when(F.count_distinct("v") == 1, F.min("v")).alias("usable"), F.min_by("v", "at").alias("first"))


def with_shared(printed: DataFrame, shared: DataFrame) -> DataFrame:
    """Printed credits (doc_id, code, usable, first) and shared_credits() of the codes that have none printed."""
    own = printed.select("doc_id", "code", "usable", "first")
    return own.unionByName(shared.join(own.hint("merge"), ["doc_id", "code"], "left_anti"))


def codeless_rows(grid: DataFrame, known: DataFrame, rows: DataFrame, label: str, least: int = 10) -> DataFrame:
    """Table rows that only the code cell of the row above covers, as new rows (doc_id, page, code, name, name_en, credits, year, semester, category, type, note).

    A line of the name, white space aside, must be the name of just one code
    (known: doc_id, name, code; names of `least` characters or more; lines
    that the label pattern opens are none), and all such lines of the cell of
    the same code. The row must have credits, and rows (doc_id, ordinal, page,
    code, year, semester, category, type) no row of that code on the page. The
    term is that of the first row of the code above on this page; without one
    there is no new row. name_en is the next line, if it isn't of the first
    script.
    """
    name_of = known.filter(F.col("code").rlike("^[0-9]{8}$")).select("doc_id", _bare(F.col("name")).alias("key"), "code").filter(F.length("key") >= least)
    single = name_of.groupBy("doc_id", "key").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).filter("n = 1").drop("n")
    above = _bare(F.get("cells", F.lit(0)))
    covered = _own(grid).filter(F.get("inherited", F.lit(0)) & above.rlike(CODE_CELL)).select("doc_id", "page_no", "table_no", "row_no", above.alias("above"), "own")
    paid = F.filter(F.slice("own", F.lit(2), F.greatest(F.size("own") - 1, F.lit(0))), lambda c: c.rlike(CREDITS))
    covered = covered.filter(F.size("own") > 1).withColumn("credits", _bare(F.regexp_extract(F.get(paid, F.size(paid) - 1), f"({CREDITS})", 1))).filter("credits <> ''")
    lines = F.split(F.get("own", F.lit(0)), "\n")
    each = covered.select(*TABLE, "row_no", "above", "credits", lines.alias("lines"), F.posexplode(lines).alias("at", "line")).filter(~F.col("line").rlike(label))
    met = each.withColumn("key", _bare(F.col("line"))).join(single.hint("merge"), ["doc_id", "key"])
    following = F.get("lines", F.col("at") + 1)
    one = met.groupBy(*TABLE, "row_no", "above", "credits").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code"), F.min_by(F.struct(F.trim("line").alias("name"), F.when(~following.rlike(FIRST_SCRIPT), F.trim(following)).alias("name_en")), "at").alias("x")).filter("n = 1")
    new = one.join(rows.select("doc_id", F.col("page").alias("page_no"), "code").distinct().hint("merge"), ["doc_id", "page_no", "code"], "left_anti")
    new = new.groupBy("doc_id", "page_no", "code").agg(F.min_by(F.struct("above", "credits", "x"), F.struct("table_no", "row_no")).alias("r"))
    placed = rows.filter("year is not null and semester is not null").groupBy("doc_id", F.col("page").alias("page_no"), F.upper(_bare(F.col("code"))).alias("above")).agg(F.min_by(F.struct("year", "semester", "category", "type"), "ordinal").alias("s"))
    found = new.withColumn("above", F.upper("r.above")).join(placed.hint("merge"), ["doc_id", "page_no", "above"])
    return found.select("doc_id", F.col("page_no").alias("page"), "code", "r.x.name", "r.x.name_en", "r.credits", "s.year", "s.semester", "s.category", "s.type", F.concat(F.lit("no code in its row, below "), "above").alias("note"))


def group_or_rows(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows (doc_id, ordinal, page, code, name, year, semester, alt_group) whose codes stand together in one cell become one group where a row inside its span begins with "or".

    The cell holds two codes or more and nothing else. Two of them must have
    rows on the page, all in one term. Rows that an earlier repair brought
    back (RECOVERED) for the line that begins with "or" go. A code in several
    such cells is of the last one.
    """
    # each row says its cells and, as column -1, whether it begins with "or"; written, so that tables are read once for both
    each = F.transform(F.arrays_zip("cells", "origin"), lambda x, i: F.struct(i.alias("col"), x["origin"].alias("first"), x["cells"].alias("text")))
    opens = F.when(_bare(F.get("own", F.lit(0))).rlike(OPENS_OR), F.array(F.struct(F.lit(-1).alias("col"), F.col("row_no").alias("first"), F.lit("").alias("text"))))
    marks = _own(grid).select(*TABLE, "row_no", F.explode(F.concat(F.filter(each, lambda x: x["first"].isNotNull()), F.coalesce(opens, F.array()))).alias("x"))
    marks = marks.groupBy(*TABLE, "x.col", "x.first").agg(F.max("row_no").alias("last"), F.min("x.text").alias("text")).filter((F.col("col") < 0) | (F.col("last") > F.col("first")) & F.col("text").rlike(r"^(?:[0-9]{8}\s*){2,}$"))
    marks = written(marks, "marks")
    cells = marks.filter("col >= 0").select(*TABLE, "first", "last", "text").distinct().withColumn("codes", _codes(F.col("text"))).filter("size(codes) >= 2")
    says = marks.filter("col < 0").select(*TABLE, F.col("first").alias("row_no"))
    inside = (F.col("row_no") > F.col("first")) & (F.col("row_no") <= F.col("last"))
    # a table's rows are few: an equal table, then the interval
    choice = cells.join(says.hint("merge"), TABLE).filter(inside).select(*TABLE, "first", "codes").distinct()
    asked = choice.select(F.col("doc_id"), F.col("page_no").alias("page"), "table_no", "first", "codes", F.explode("codes").alias("code"))
    again = F.coalesce(F.col("alt_group").startswith(RECOVERED) & F.ltrim("name").rlike(OPENS_OR), F.lit(False))
    met = rows.withColumn("__again", again).join(asked.hint("merge"), ["doc_id", "page", "code"]).select("doc_id", "page", "table_no", "first", "codes", "code", "ordinal", "__again", F.when(~F.col("__again"), F.struct("year", "semester")).alias("t"), (F.col("year").isNotNull() & F.col("semester").isNotNull() & ~F.col("__again")).alias("placed"))
    key = ["doc_id", "page", "table_no", "first"]
    held = met.groupBy(*key).agg(F.count_distinct(F.when(F.col("placed"), F.col("code"))).alias("n"), F.min(F.when(F.col("placed"), F.col("t"))).alias("lo"), F.max(F.when(F.col("placed"), F.col("t"))).alias("hi"), F.min(F.get("codes", F.lit(0))).alias("c")).filter("n >= 2 and lo = hi")
    name = F.concat(F.lit("alt_y"), "lo.year", F.lit("s"), "lo.semester", F.lit("_or_"), "c")
    decided = met.join(held.hint("merge"), key).groupBy("doc_id", "ordinal").agg(F.max("__again").alias("__drop"), F.max_by(F.when(F.col("placed"), name), F.struct("page", "table_no", "first")).alias("__g"))
    joined = rows.join(decided.hint("merge"), ["doc_id", "ordinal"], "left").filter("__drop is null or not __drop")
    return joined.withColumn("alt_group", F.coalesce("__g", "alt_group")).select(*rows.columns)


def split_merged_cells(rows: DataFrame, grid: DataFrame, separator: str, next_pages: DataFrame) -> DataFrame:
    """Rows (doc_id, ordinal, page, code, name, name_en, credits, year, semester, category, type, inferred) of which two were read from one cell of two codes, put right; note tells what changed.

    The cell's names are parted by one separator line; the row below gives a
    third name. Only where the first code's row has both first names run
    together, and the second code's row the third name, is anything changed:
    each gets its own names; the first one's credits, if all rows of that code
    and name have one choice ("or"), and the second one's type and category,
    if all agree, are taken from them. A wildcard row of the third name that
    was inferred for the next page, whose text (next_pages: doc_id, page_no,
    text) lacks the name, moves to this page and term. What isn't confirmed
    stays.
    """
    lines = F.filter(F.transform(F.split(F.get("cells", F.lit(1)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    codes = F.filter(F.transform(F.split(F.get("cells", F.lit(0)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first_script = lambda xs: F.array_join(F.filter(xs, lambda x: x.rlike(FIRST_SCRIPT)), " ")
    other = lambda xs: F.array_join(F.filter(xs, lambda x: ~x.rlike(FIRST_SCRIPT)), " ")
    order = Window.partitionBy(*TABLE).orderBy("row_no")
    own = _own(grid).withColumns({"below": F.lead("own").over(order), "codes": codes, "lines": lines})
    own = own.filter((F.size("own") >= 3) & (F.size("codes") == 2) & F.forall("codes", lambda c: c.rlike(CODE_CELL)) & (F.size(F.filter("lines", lambda x: x.rlike(separator))) == 1) & (F.size("below") == 2))
    at = F.array_position(F.transform("lines", lambda x: x.rlike(separator)), True).cast("int")
    third = F.split(F.get("below", F.lit(0)), "\n")
    own = own.withColumns({"a": F.slice("lines", F.lit(1), at - 1), "b": F.slice("lines", at + 1, F.size("lines"))})
    cell = own.select("doc_id", F.col("page_no").alias("page"), "table_no", "row_no", F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"), first_script("a").alias("n1"), other("a").alias("e1"), first_script("b").alias("n2"), other("b").alias("e2"), first_script(third).alias("n3")).filter("n1 <> '' and n2 <> '' and e1 <> '' and e2 <> '' and n3 <> ''")
    cell = written(cell, "cells")
    key = ["doc_id", "page", "table_no", "row_no"]
    # each name that a cell asks of rows, so that rows are sorted and met once for all of them
    entry = lambda kind, code, *names: F.struct(F.lit(kind).alias("kind"), F.lower(code).alias("c"), F.concat(*(_bare(F.col(n)) for n in names)).alias("__n"))
    asked = cell.select(*key, F.explode(F.array(entry("one", F.col("c1"), "n1", "n2"), entry("two", F.col("c2"), "n3"), entry("first", F.col("c1"), "n1"), entry("second", F.col("c2"), "n2"), entry("third", F.lit(None).cast("string"), "n3"))).alias("x")).select(*key, "x.*")
    said = rows.select("doc_id", _bare(F.col("name")).alias("__n"), F.lower("code").alias("__c"), F.col("page").alias("__at"), "ordinal", "year", "semester", "credits", "type", "category", "inferred")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    fits = F.when(is_("third"), F.col("inferred") & F.col("__c").contains("x") & (F.col("__at") - 1 == F.col("page"))).otherwise((F.col("c") == F.col("__c")) & (is_("first", "second") | (F.col("__at") == F.col("page"))))
    first_of = lambda kind: F.min(F.when(is_(kind), F.col("ordinal"))).over(Window.partitionBy(*key))
    met = asked.join(said.hint("merge"), ["doc_id", "__n"]).filter(fits).select(*key, "kind", "ordinal", "year", "semester", "credits", "type", "category").withColumns({"o1": first_of("one"), "o2": first_of("two")})

    def agreed(c: str, kind: str, but: str) -> Column:
        value = F.when(is_(kind) & (F.col("ordinal") != F.col(but)) & (F.col(c) != ""), F.col(c))
        return F.when(F.min(value) == F.max(value), F.min(value))

    found = met.groupBy(*key).agg(
        F.min("o1").alias("o1"), F.min("o2").alias("o2"), F.min_by(F.struct("year", "semester"), F.when(is_("two"), F.col("ordinal"))).alias("t"),
        agreed("credits", "first", "o1").alias("k1"), agreed("type", "second", "o2").alias("type2"), agreed("category", "second", "o2").alias("category2"), F.min(F.when(is_("third"), F.col("ordinal"))).alias("o3"),
    ).filter("o1 is not null and o2 is not null")
    sure = written(cell.join(found.hint("merge"), key), "sure")
    told = ["name", "name_en", "credits", "type", "category", "year", "semester", "page"]
    none = F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("int")
    fix = lambda ordinal, note, **have: sure.select("doc_id", F.col(ordinal).alias("ordinal"), *(have.get(c, none if c in told[:5] else F.lit(None).cast("int")).alias(f"__{c}") for c in told), F.lit(note).alias("note"))
    fixed = fix("o1", "name parted from the next one of its cell", name=F.col("n1"), name_en=F.col("e1"), credits=F.when(F.col("k1").rlike(OR_WORD), F.col("k1")))
    fixed = fixed.unionByName(fix("o2", "had the name of the row below its cell", name=F.col("n2"), name_en=F.col("e2"), type=F.col("type2"), category=F.col("category2")))
    text = next_pages.select("doc_id", (F.col("page_no") - 1).alias("page"), _bare(F.regexp_replace("text", "<[^>]+>", " ")).alias("__text"))
    moved = sure.filter("o3 is not null").join(text.hint("merge"), ["doc_id", "page"], "left").filter(~F.contains(F.coalesce("__text", F.lit("")), _bare(F.col("n3"))))
    moved = moved.select("doc_id", F.col("o3").alias("ordinal"), *(none.alias(f"__{c}") for c in told[:5]), F.col("t.year").cast("int").alias("__year"), F.col("t.semester").cast("int").alias("__semester"), number("page").alias("__page"), F.lit("moved to the page that prints its name").alias("note"))
    changes = fixed.unionByName(moved).groupBy("doc_id", "ordinal").agg(*(F.max(f"__{c}").alias(f"__{c}") for c in told), F.min("note").alias("note"))
    joined = rows.join(changes.hint("merge"), ["doc_id", "ordinal"], "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in told}).select(*rows.columns, "note")
