"""From extracted rows to the relational model, and what tables and descriptions still hold."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantables.functions import text as f
from plantables.operators.evaluate import align_rows, field_stats
from plantables.operators import repair
from plantables.operators.changes import with_log
from plantables.operators.pages import HEAD_WORD, TOTAL_WORD, assign_alt_groups, assign_section, explode_tables, grid_rows, group_entries, group_rowspan_rows, skipped_tables, table_terms
from plantables.sources.scratch import written


#: Characters of a name's piece by which names are joined.
GRAM = 3


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts are: twice the matched characters by all characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def convert_rows(rows: DataFrame, scope: list[str]) -> dict[str, DataFrame]:
    """Extracted rows (scope, ordinal, code, name, credits text, year, semester, category, prerequisite) to tables.

    Several codes of a row are alternatives of one group. A wildcard is a
    placeholder. A row with a term goes to the plan, another to the slots.
    Credits that can't be read are unknown for the course, 0 for the plan.
    -> plan, slot, course, prerequisite, counts, and rejected: the rows whose
    code says none, which are in no other table.
    """
    codes = f.split_code_alternatives(F.col("code"))
    read = f.parse_credits(F.col("credits"))
    each = rows.withColumns({"__codes": codes, "known_credits": read["credits"], "__error": read["error"]}).withColumn("__n", F.size("__codes"))
    one = each.withColumn("__code", F.explode("__codes")).withColumns(
        {
            "code": F.coalesce(f.placeholder_code(F.col("__code")), F.col("__code")),
            "alt_group": F.coalesce(F.col("alt_group") if "alt_group" in rows.columns else F.lit(None), F.when(F.col("__n") > 1, F.concat(F.lit("alt-"), F.col("ordinal").cast("string")))),
            "planned": F.coalesce(F.col("year").between(1, 8) & F.col("semester").between(1, 3), F.lit(False)),
        }
    )
    plan = one.filter("planned").select(*scope, "ordinal", "code", "year", "semester", F.coalesce("known_credits", F.lit(0)).alias("credits"), "alt_group", "category")
    slot = one.filter("not planned").select(*scope, "ordinal", "code", F.col("known_credits").alias("credits"), "alt_group", "category")
    course = one.groupBy("code").agg(F.min_by("name", "ordinal").alias("name"), F.min_by("known_credits", F.when(F.col("known_credits").isNotNull(), F.col("ordinal"))).alias("credits"))
    edges = one.select("code", F.explode(f.course_codes(F.col("prerequisite"))).alias("requires")).filter("code <> requires and not startswith(code, 'PLACEHOLDER_')").distinct().withColumn("kind", F.lit("pre"))
    counts = one.groupBy(*scope).agg(
        F.count_if("planned").alias("n_plan"), F.count_if(~F.col("planned")).alias("n_slot"), F.count_if(F.col("code").startswith("PLACEHOLDER_")).alias("n_placeholder"), F.count_if("__error").alias("n_unreadable")
    )
    rejected = each.filter(F.coalesce(F.col("__n"), F.lit(-1)) <= 0).select(*scope, "ordinal", "code", "name", F.when(F.trim(F.coalesce("code", F.lit(""))) == "", "no code").otherwise("code not read").alias("reason"))
    return {"plan": plan, "slot": slot, "course": course, "prerequisite": edges, "counts": counts, "rejected": rejected}


def printed_credits(cells: DataFrame) -> DataFrame:
    """(doc_id, code, credits) cells -> by code the distinct printed values; usable where there is one."""
    return (
        cells.filter("credits is not null and credits <> ''")
        .groupBy("doc_id", "code")
        .agg(F.count_distinct("credits").alias("n_values"), F.min("credits").alias("credits"))
        .select("doc_id", "code", "n_values", F.when(F.col("n_values") == 1, F.col("credits")).alias("usable"))
    )


#: A code that opens a line, a line of a total alone, and credits that end a line.
LEAD_CODE, TOTAL_LINE, CREDIT_TAIL = r"^\s*([0-9xX]{8})(?:\s+(.*))?$", r"(?i)^(?:total|รวม)\s*([0-9]+)\s*$", r"([0-9]+\s*\(\s*[0-9xX]+\s*-\s*[0-9xX]+\s*-\s*[0-9xX]+\s*\))\s*$"


def normalize_grid_rows(rows: DataFrame) -> DataFrame:
    """T4: grid rows (doc_id, page_no, table_no, row_no, cells, inherited, origin) -> the same, with item and kind, where rows of one or two cells are code, name and credits.

    The lines of a merged cell are items: a code opens one, the lines after it
    belong to it, a line of a total stands alone; lines before any code are
    dropped. Of two cells the first gives the code (and what stands behind
    it), the second the lines. Credits at the end of an item's last line are
    its credits. A cell of credits alone is a row without code and name. Rows
    of three cells or more, header rows, totals and rows under a span pass as
    they are. A code that follows credits in one line begins a line. kind is
    row, credits, course or total; row_no counts the rows that come out.
    """
    key = ["doc_id", "page_no", "table_no"]
    given = F.transform(F.filter(F.arrays_zip("cells", "origin"), lambda x: x["origin"].isNotNull()), lambda x: x["cells"])
    own = rows.withColumn("__own", given).withColumn("__first", F.coalesce(F.get("__own", F.lit(0)), F.lit("")))
    head = F.exists("__own", lambda c: c.rlike(HEAD_WORD)) | F.col("__first").rlike(TOTAL_WORD)
    whole = (F.size("__own") >= 3) | (F.size("__own") == 0) | head | F.exists("inherited", lambda x: x)
    alone = (F.size("__own") == 1) & F.col("__first").rlike(ONLY_CREDITS)
    told = own.withColumn("kind", F.when(whole, "row").when(alone, "credits").otherwise("lines"))
    lines = lambda c: F.split(F.regexp_replace(c, r"(\([0-9xX]+\s*-\s*[0-9xX]+\s*-\s*[0-9xX]+\s*\))[ \t]+(?=[0-9xX]{8}\s)", "$1\n"), "\n")
    piece = lambda opens, code, line: F.struct(F.lit(opens).alias("opens"), code.alias("code"), F.trim(line).alias("line"))
    none, total = F.lit(""), lambda x: piece("total", F.lit(""), F.regexp_extract(x, TOTAL_LINE, 1))
    merged, two = F.col("kind") == "lines", F.size("__own") == 2
    # what several values need is a column, so that each row's lines are cut and read once, in the task that has the row
    told = told.withColumns({"__lines": F.when(merged, lines(F.col("__first"))), "__more": F.when(merged & two, lines(F.get("__own", F.lit(1))))})
    opening = F.get("__lines", F.lit(0))
    told = told.withColumns({"__code": F.when(merged & two, F.regexp_extract(opening, LEAD_CODE, 1)), "__behind": F.when(merged & two, F.regexp_extract(opening, LEAD_CODE, 2))})
    # of two cells, the whole first one opens the only course; its second cell's lines follow, with codes in it no codes
    split = (F.col("__code") != "") & ((F.size("__lines") > 1) | (F.col("__behind") != ""))
    own_lines = F.when(split, F.concat(F.array(piece("course", F.col("__code"), F.col("__behind"))), F.transform(F.slice("__lines", F.lit(2), F.size("__lines")), lambda x: piece("", none, x)))).otherwise(F.array(piece("course", F.col("__first"), none)))
    pair = F.concat(own_lines, F.transform("__more", lambda x: F.when(x.rlike(TOTAL_LINE), total(x)).otherwise(piece("", none, x))))
    single = F.transform("__lines", lambda x: F.when(x.rlike(TOTAL_LINE), total(x)).when(x.rlike(LEAD_CODE), piece("course", F.regexp_extract(x, LEAD_CODE, 1), F.regexp_extract(x, LEAD_CODE, 2))).otherwise(piece("", none, x)))
    told = told.withColumn("__pieces", F.when(merged & two, pair).when(merged, single))
    # in one cell, lines after a total belong to nothing; of two cells, they go on with the only course
    places = F.filter(F.transform("__pieces", lambda x, i: F.when(x["opens"] != "", i)), lambda i: i.isNotNull())
    told = told.withColumn("__places", F.when(~two, places))
    runs = F.transform("__places", lambda p, j: F.slice("__pieces", p + 1, F.coalesce(F.get("__places", j + 1), F.size("__pieces")) - p))
    of_two = F.concat(F.array(F.filter("__pieces", lambda x: x["opens"] != "total")), F.transform(F.filter("__pieces", lambda x: x["opens"] == "total"), lambda x: F.array(x)))
    told = told.withColumn("__runs", F.when(two, of_two).otherwise(runs))
    each = told.select(*key, "row_no", "kind", "cells", "inherited", "origin", "__first", F.posexplode(F.when(merged, F.col("__runs")).otherwise(F.array(F.array().cast("array<struct<opens:string,code:string,line:string>>")))).alias("__at", "__l"))
    # from here on a row is an item, whose values need no lambda
    each = each.withColumns({"__head": F.get("__l", F.lit(0)), "__said": F.array_remove(F.col("__l.line"), "")}).withColumn("__last", F.coalesce(F.get("__said", F.size("__said") - 1), F.lit("")))
    each = each.withColumn("__tail", F.regexp_extract("__last", CREDIT_TAIL, 1)).withColumn("__rest", F.when(F.col("__tail") == "", F.col("__last")).otherwise(F.trim(F.regexp_replace("__last", CREDIT_TAIL, ""))))
    name = F.array_join(F.array_remove(F.concat(F.slice("__said", F.lit(1), F.greatest(F.size("__said") - 1, F.lit(0))), F.array("__rest")), ""), "\n")
    made = F.when(F.col("__head.opens") == "total", F.array(F.lit("Total"), F.lit("Total"), F.col("__head.line"))).otherwise(F.array(F.col("__head.code"), name, F.col("__tail")))
    row = F.col("kind") == "row"
    each = each.withColumn("__cells", F.when(row, F.col("cells")).when(merged, made).otherwise(F.array(F.lit(""), F.lit(""), F.col("__first"))))
    n = F.size("__cells")
    every = each.select(
        *key, "row_no", F.when(merged, F.col("__at") + 1).otherwise(F.lit(0)).alias("item"), F.when(merged, F.col("__head.opens")).otherwise(F.col("kind")).alias("kind"), F.col("__cells").alias("cells"),
        F.when(row, F.col("inherited")).otherwise(F.array_repeat(F.lit(False), n)).alias("inherited"), F.when(row, F.col("origin")).otherwise(F.array_repeat(F.col("row_no").cast("int"), n)).alias("origin"),
    )
    return every.withColumn("row_no", (F.row_number().over(Window.partitionBy(*key).orderBy("row_no", "item")) - 1).cast("int"))


#: Credits with nothing else, and an "or" at the end.
ONLY_CREDITS, ENDS_OR = r"^\s*[0-9]{1,2}\s*\([0-9xX]+\s*-\s*[0-9xX]+\s*-\s*[0-9xX]+\)\s*$", r"(?i)(\bor|หรือ)\s*$"


def drop_repeated(rows: DataFrame, by: list[str], alike: float = 0.97, label: str = r"(?i)^(elective|วิชาเลือก)") -> DataFrame:
    """Rows (by, pos, code, name, credits, inherited, inherited_name) without those that repeat the row before.

    A row goes if it inherits its code, which is that of the row before, has
    the same credits, not empty, the same digits in the name and a name alike;
    or if it inherits its name, has no credits and the code and name of the
    row before. Of the rows left, one that inherits the code and has credits
    only, under an elective (`label`) whose credits end with an "or", is added
    to that one's credits.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    before = lambda df: df.withColumns({f"__{c}": F.lag(c).over(w) for c in ("code", "credits", "name")})
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    paid = F.trim(F.coalesce("credits", F.lit(""))) != ""
    same = F.col("code") == F.col("__code")
    maybe = F.col("inherited") & same & paid & (F.trim("credits") == F.trim("__credits")) & (digits("name") == digits("__name"))
    again = F.col("inherited_name") & ~paid & same & (F.col("name") == F.col("__name"))
    told = before(rows).withColumns({"__r": F.when(F.coalesce(maybe, F.lit(False)), ratio("name", "__name")), "__again": F.coalesce(again, F.lit(False))})
    kept = before(told.filter(~F.col("__again") & F.coalesce(F.col("__r") < alike, F.lit(True))).select(*rows.columns))
    more = F.coalesce(F.col("inherited") & same & F.col("credits").rlike(ONLY_CREDITS) & F.col("__credits").rlike(ENDS_OR) & F.col("name").rlike(label) & F.col("__name").rlike(label), F.lit(False))
    marked = kept.withColumn("__more", more)
    added = F.when(F.lead("__more").over(w), F.concat_ws(" ", F.rtrim("credits"), F.trim(F.lead("credits").over(w)))).otherwise(F.col("credits"))
    return marked.withColumn("credits", added).filter(~F.col("__more")).select(*rows.columns)


def number_series(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a series without a number get the next ones after the largest there is, in order."""
    own = rows.withColumn("__has", F.col("number").isNotNull())
    top = F.coalesce(F.max("number").over(Window.partitionBy(*by)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*by, "__has").orderBy("ordinal"))
    return own.withColumn("number", F.when(F.col("__has"), F.col("number")).otherwise(top + nth)).drop("__has")


def realign_codes(rows: DataFrame, by: list[str], wildcard: str) -> DataFrame:
    """In a table (by) whose electives hold real codes, the codes slipped: rows (by, pos, code, name, elective).

    The distinct real codes from the first such row on go, in order, to the
    named rows after it that aren't electives, if they are as many; electives
    with a real code get the wildcard either way.
    """
    w = Window.partitionBy(*by)
    real = F.coalesce(F.col("code").rlike("^[0-9]{8}$"), F.lit(False))
    own = rows.withColumns({"__real": real, "__bad": F.col("elective") & real}).withColumn("__from", F.min(F.when(F.col("__bad"), F.col("pos"))).over(w))
    own = own.withColumn("__slot", F.coalesce(~F.col("elective") & (F.col("pos") > F.col("__from")) & (F.trim("name") != ""), F.lit(False)))
    own = own.withColumn("__nth", F.when(F.col("__slot"), F.sum(F.col("__slot").cast("int")).over(w.orderBy("pos"))))
    codes = own.filter("__real and pos >= __from").groupBy(*by, "code").agg(F.min("pos").alias("__pos"))
    codes = codes.select(*by, F.col("code").alias("__code"), F.row_number().over(w.orderBy("__pos")).alias("__nth"), F.count("*").over(w).alias("__n"))
    counted = own.withColumn("__slots", F.sum(F.col("__slot").cast("int")).over(w))
    joined = counted.join(codes, [*by, "__nth"], "left")
    code = F.when(F.col("__bad"), F.lit(wildcard)).when(F.col("__n") == F.col("__slots"), F.col("__code")).otherwise(F.col("code"))
    return joined.withColumn("code", code).select(*rows.columns)


def catalog_fallback(listed: DataFrame, known: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of list tables whose code isn't known, for documents that have no plan table."""
    return listed.join(planned.select("doc_id").distinct(), "doc_id", "left_anti").join(known.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti")


def code_by_name(rows: DataFrame, named: DataFrame, alike: tuple[int, int] = (9, 10), label: str | None = None) -> DataFrame:
    """Rows with a wildcard code get the code of the most similar name of their document, if alike enough; ties by code.

    alike is a fraction of whole numbers, and so are all bounds. With a label
    (a pattern) only rows whose name has it take part, on both sides, and
    names are compared without it and without white space. A ratio of r leaves at most (1 - r) of both texts' characters unmatched, u
    of them. Cut into u + 1 pieces, a name has one piece that stands whole in
    the other: pieces' first characters are joined with all places of the
    other name, which loses no pair. Length and edit distance, which u also
    bounds, then leave few pairs whose ratio is computed. The pieces are more
    than Spark estimates, so they are merged, not broadcast.
    """
    num, den = alike
    has = (lambda c: F.col(c).rlike(label)) if label else (lambda c: F.lit(True))
    key = (lambda c: F.regexp_replace(F.regexp_replace(c, label, ""), r"(?U)\s+", "")) if label else F.col
    # the other name is at most (2 - r) / r times as long, and u is (1 - r) of both lengths
    spare = F.floor(F.length("__text") * (2 * (den - num)) / num).cast("int")
    asked = rows.filter(F.col("code").startswith("PLACEHOLDER_") & has("name")).select("doc_id", key("name").alias("__text")).filter("__text <> ''").distinct().withColumn("__u", spare)
    size = F.greatest(F.lit(1), F.floor(F.length("__text") / (F.col("__u") + 1)).cast("int"))
    cuts = F.transform(F.sequence(F.lit(0), F.col("__u")), lambda k: F.substr("__text", (k * size + 1).cast("int"), F.least(size, F.lit(GRAM))))
    keyed = asked.withColumn("__key", F.explode(F.array_distinct(F.filter(cuts, lambda x: x != ""))))
    real = named.filter(F.col("code").rlike("^[0-9]{8}$") & has("name")).select("doc_id", key("name").alias("__name"), F.col("code").alias("__code")).filter("__name <> ''").distinct()
    at = F.sequence(F.lit(1), F.length("__name"))
    spread = real.withColumn("__key", F.explode(F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substr("__name", i, n)))))))
    most = (F.length("__text") + F.length("__name")) * (den - num)
    near = keyed.join(spread.hint("merge"), ["doc_id", "__key"]).filter(F.abs(F.length("__text") - F.length("__name")) * den <= most).select("doc_id", "__text", "__name", "__code").distinct()
    scored = near.filter(F.levenshtein("__text", "__name") * den <= most).withColumn("__r", ratio("__text", "__name")).filter(F.col("__r") >= num / den)
    best = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.desc("__r"), "__code"))
    top = scored.withColumn("__n", best).filter("__n = 1").select("doc_id", "__text", "__code")
    joined = rows.withColumn("__text", F.when(has("name"), key("name") if label else F.col("name"))).join(top, ["doc_id", "__text"], "left")
    return joined.withColumn("code", F.when(F.col("code").startswith("PLACEHOLDER_"), F.coalesce("__code", "code")).otherwise(F.col("code"))).select(*rows.columns)


def description_blocks(
    lines: DataFrame, heading: str, follow: str, within: int = 4, bare: str | None = None, listed: tuple[str, str] | None = None, category: str | None = None, group: str | None = None, most: int = 8
) -> DataFrame:
    """Lines of a document (doc_id, line_no, line) with opens, block, kind, category and group.

    A heading opens a block; one of a code only (`bare`; without it each
    heading) does so only if a line that follows within a few matches
    `follow`, and the line before is no part of a list. Lines after the first
    label of `listed` and before the next line of its second, `most` lines
    on at the latest, go on with the list of codes: kind listed. Lines of
    category and group headings are carried to the lines below; a category
    ends the group. kind is head, category, group, listed or text.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    says = lambda pattern: F.coalesce(F.col("line").rlike(pattern), F.lit(False)) if pattern else F.lit(False)
    opened, closed = (says(x) for x in listed or (None, None))
    own = lines.withColumns({"__at": F.row_number().over(w), "__opened": opened, "__closed": closed})
    is_listed = in_list = F.lit(False)
    if listed:  # each frame of lines is a window of its own, so only those asked for are made
        event = F.when(F.col("__opened") | F.col("__closed"), F.struct("__at", F.col("__opened").alias("o")))
        last, end = F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min(F.when(F.col("__closed"), F.col("__at"))).over(w.rowsBetween(1, most))
        is_listed = F.coalesce(last["o"] & ~F.col("__closed") & (end - last["__at"] <= most), F.lit(False))
        in_list = F.coalesce(F.lag(F.col("__listed") | F.col("__opened")).over(w), F.lit(False))
    own = own.withColumn("__listed", is_listed)
    soon = F.coalesce(F.max(says(follow).cast("int")).over(w.rowsBetween(1, within)) == 1, F.lit(False))
    alone = (says(bare) if bare else F.lit(True)) & ~(soon & ~in_list)
    own = own.withColumn("opens", says(heading) & ~F.col("__listed") & ~alone)
    titled = says(category) & (F.length("line") < 70) & ~F.col("__opened")
    kind = F.when(F.col("opens"), "head").when(titled, "category").when(says(group) & (F.length("line") < 90), "group").when(F.col("__listed"), "listed").otherwise("text")
    own = own.withColumn("kind", kind)
    carried = lambda k: F.last(F.when(F.col("kind") == k, F.struct("__at", "line")), ignorenulls=True).over(so_far)
    none = F.lit(None).cast("struct<__at:int,line:string>")
    own = own.withColumns({"__c": carried("category") if category else none, "__g": carried("group") if group else none, "block": F.sum(F.col("opens").cast("int")).over(so_far)})
    told = own.withColumns({"category": F.col("__c.line"), "group": F.when(F.col("__c").isNull() | (F.col("__g.__at") > F.col("__c.__at")), F.col("__g.line"))})
    return told.select(*lines.columns, "opens", "block", "kind", "category", "group")


def evaluate_extraction(truth: DataFrame, pred: DataFrame, passes: list[list[str]], fields: list[str]) -> DataFrame:
    """field_stats() of truth rows with a name against what the passes align with them, words of names too.

    A missed row counts as deleted in all fields but prerequisite and flexible.
    """
    real = truth.filter("name is not null and name <> ''")
    joined = align_rows(real, pred, passes, fields).filter("t_id is not null").withColumn("__missed", F.col("p_id").isNull())
    return field_stats(joined, fields, words=[f for f in fields if f.startswith("name")], key="t_id", missed="__missed", exempt=["prerequisite", "flexible"])


def write_metrics(metrics: DataFrame, path: str, kind: str = "csv") -> None:
    """A metrics table as CSV with a header, or a report as JSON lines."""
    writer = metrics.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


#: A line of hours only, with or without a number of credits before them.
CREDIT_LINE = r"^([0-9]{1,2})?\s*\(\s*([0-9]+)\s*-\s*([0-9]+)\s*-\s*([0-9]+)\s*\)$"
HOURS = r"\(\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})\s*\)"


def head_roles(lines: DataFrame, native: str, label: str, note: str | None = None, width: int = 110) -> DataFrame:
    """Lines of blocks (doc_id, block, line_no, line) with role: head, credits, note, pre, text or other.

    A head runs over several lines. It ends at a label line (pre), at a line
    with letters of `native` once Latin ones have come, or at one longer than
    `width`; those two begin the text. Lines of credits alone are no part of
    it wherever they stand, nor are notes (of electives, say) within it. After
    the head, lines without native letters are other. kind of
    description_blocks() tells listed lines, which are pre. Blocks are sorted
    by lines, each in one pass; null lines are empty ones.
    """
    w = Window.partitionBy("doc_id", "block").orderBy("line_no")
    says = lambda pattern: F.col("__text").rlike(pattern) if pattern else F.lit(False)
    first = F.row_number().over(w) == 1
    listed = F.coalesce(F.col("kind") == "listed", F.lit(False)) if "kind" in lines.columns else F.lit(False)
    plain = F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\*", ""))
    own = lines.filter("block > 0").withColumns({"__first": first, "__text": plain, "__listed": listed})
    own = own.withColumns({"__text": F.when(F.col("__first"), F.regexp_replace("__text", r"^[0-9]{8}\s*", "")).otherwise(F.col("__text"))})
    pre = ~F.col("__first") & (says(label) | F.col("__listed"))
    own = own.withColumns({"__pre": pre, "__paid": ~F.col("__first") & says(CREDIT_LINE), "__note": ~F.col("__first") & says(note)})
    named = ~F.col("__pre") & ~F.col("__paid") & ~F.col("__note")
    latin = F.coalesce(F.max(named & says("[A-Za-z]{2}")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    own = own.withColumn("__ends", F.col("__pre") | ~F.col("__first") & named & (latin & says(native) | (F.length("__text") > width)))
    over = F.max("__ends").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    role = F.when(F.col("__paid"), "credits").when(F.col("__pre"), "pre").when(~over & F.col("__note"), "note").when(~over, "head").when(F.col("__ends") | says(native), "text").otherwise("other")
    return own.withColumn("role", role).select(*lines.columns, "role")


def _with_head_names(blocks: DataFrame, native: str) -> DataFrame:
    """Blocks with __heads, pieces of a head -> also __two, struct(name, name_en): native stretches joined, Latin ones joined by a space.

    Where a later piece is Latin as a whole, Latin at the end of native pieces belongs to them.
    """
    later = F.slice("__heads", 2, 1 << 20)
    blocks = blocks.withColumn("__whole", F.exists(later, lambda x: ~x.rlike(native) & x.rlike("[A-Za-z]")))
    two = F.transform("__heads", lambda x: F.when(F.col("__whole") & x.rlike(native), F.struct(F.trim(x).alias("first"), F.lit("").alias("second"))).otherwise(f.split_bilingual_name(x)))
    blocks = blocks.withColumn("__parts", F.transform(two, lambda x, i: F.struct(x["first"].alias("first"), x["second"].alias("second"), ((i == 0) | x["first"].rlike(native)).alias("mine"))))
    name = F.array_join(F.transform(F.filter("__parts", lambda x: x["mine"]), lambda x: x["first"]), "")
    others = F.flatten(F.transform("__parts", lambda x: F.array(F.when(x["mine"], "").otherwise(x["first"]), x["second"])))
    name_en = F.regexp_replace(F.array_join(F.filter(others, lambda x: x != ""), " "), r"\s+", " ")
    return blocks.withColumn("__two", F.struct(F.trim(name).alias("name"), F.trim(name_en).alias("name_en")))


def _block_parts(lines: DataFrame, label: str, most: int, native: str | None, note: str | None) -> DataFrame:
    """Lines of blocks -> a row for each block that begins with a code: code, __heads (pieces of its head), credits, __derived, what it requires and its text."""
    has = lambda c: c in lines.columns
    w = Window.partitionBy("doc_id", "block")
    own = lines.filter("block > 0").withColumn("__first", F.col("line_no") == F.min("line_no").over(w)).withColumn("__pre", F.col("line").rlike(label))
    listed = (F.col("kind") == "listed") if has("kind") else F.lit(False)
    if has("kind"):
        own = own.filter("kind not in ('category', 'group')")
    if native:
        own = head_roles(own, native, label, note)
    in_head = (F.col("role") == "head") if native else F.col("__first")
    in_text = (F.col("role") == "text") if native else ~F.col("__first") & ~F.col("__pre") & ~listed
    triple = F.regexp_extract("line", r"([0-9]{1,2}\([0-9xX]+-[0-9xX]+-[0-9xX]+\))", 1)
    # patterns are costly: only lines with a bracket are read for credits, hours by one pattern, and what several values need is a column
    paid = F.contains("line", F.lit("("))
    own = own.withColumn("__h", F.when(paid, F.nullif(F.regexp_extract("line", rf"(?:^|[^0-9])({HOURS})", 1), F.lit("")))).withColumn("__h", F.split(F.translate("__h", "() \t\n\r\f\x0b", ""), "-").cast("array<int>")).withColumn("__triple", F.when(paid, triple))
    own = own.withColumn("__c", f.credits_from_hours(*(F.get("__h", F.lit(i)) for i in range(3))))
    own = own.withColumn("__d", F.when(F.col("__c").isNotNull(), F.concat(F.col("__c").cast("string"), F.lit("("), F.array_join(F.col("__h").cast("array<string>"), "-"), F.lit(")"))))
    triple, derived, at = F.col("__triple"), F.col("__d"), F.col("line_no")
    rest = F.regexp_replace("line", r"^[0-9]{8}", "")
    head = F.trim(F.regexp_replace(rest, rf"[0-9]{{1,2}}\([0-9xX-]+\)|{HOURS}", ""))
    told = F.min_by(triple, F.when(triple != "", at))
    late = F.lit(None).cast("string")
    if native:
        own = own.withColumn("__rest", F.when(in_head, F.trim(F.translate(rest, "*", ""))))
        own = own.withColumn("__only", F.when(F.contains("__rest", F.lit("(")), F.col("__rest").rlike(CREDIT_LINE)))
        rest, only = F.col("__rest"), F.col("__only")
        alone = only & F.regexp_replace(rest, r"\s+", "").rlike(r"^([0-9]|1[0-2])\(")
        none = F.regexp_extract(rest, rf"(?:^|[^0-9.])(0\s+{HOURS})$", 1)
        sure = F.when(alone, F.regexp_replace(rest, r"\s+", "")).when(none != "", F.regexp_replace(none, r"\s+", "")).when(triple.rlike(r"^0?([0-9]|1[0-2])\("), triple)
        own = own.withColumn("__sure", F.when(only.isNotNull(), sure))
        head = F.when(only.isNull(), rest).when(only, "").otherwise(F.trim(F.regexp_replace(rest, rf"(?<![0-9.])0\s+{HOURS}$|[0-9]{{1,2}}\([0-9xX-]+\)|{HOURS}", "")))
        told, late = F.min_by("__sure", F.when(F.col("__sure").isNotNull(), at)), F.min_by(triple, F.when((F.col("role") == "credits") & (triple != ""), at))
        derived = F.when(F.col("role").isin("head", "credits"), derived)
    first_derived = F.min_by(derived, F.when(derived.isNotNull() & in_head, at))
    any_derived = F.coalesce(first_derived, F.min_by(derived, F.when(derived.isNotNull(), at))) if native else F.min_by(derived, F.when(derived.isNotNull(), at))
    said = F.when(F.col("__pre"), f.normalize_prerequisite(F.col("line")))
    line, texts = F.struct("line_no", "line"), lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"])
    blocks = own.groupBy("doc_id", "block").agg(
        F.min(F.when(F.col("__first"), F.regexp_extract("line", "^([0-9]{8})", 1))).alias("code"),
        F.filter(texts(F.when(in_head, F.struct("line_no", head.alias("line")))), lambda x: x != "").alias("__heads"),
        F.coalesce(told, late, any_derived).alias("credits"),
        F.coalesce(told, late).alias("__told"),
        first_derived.alias("__derived"),
        F.min_by(said, F.when(F.col("__pre"), at)).alias("__said"),
        f.normalize_prerequisite(F.array_join(texts(F.when(listed, line)), " ")).alias("__listed"),
        F.substring(F.array_join(texts(F.when(in_text, line)), " "), 1, most).alias("description"),
        *([F.collect_set("page_no").alias("pages")] if has("page_no") else []),
        *(F.min_by(c, "line_no").alias(c) for c in ("category", "group") if has(c)),
    )
    return blocks.filter("code <> ''")


def parse_blocks(lines: DataFrame, label: str = r"(?i)^prerequisite\s*:", most: int = 2000, native: str | None = None, note: str | None = None) -> DataFrame:
    """(doc_id, block, line_no, line) -> a row for each code: name, name_en, credits, prerequisite, description, n_blocks.

    The head is the block's first line, its name split where it turns to
    Latin. Credits are the first triple in the block, else a third of the
    first hours that stand without credits; a number before those hours that
    equals it is credits and no part of the name, unless the document has
    other numbers of that name. The prerequisite is the codes of the first
    label line, and of listed lines; the description the other lines joined
    and cut. Of a code's blocks the first value that isn't empty counts. With
    page_no, kind, category or group of description_blocks(): also pages of
    all its blocks, and headings are no text.

    With `native`, a pattern of the first script's letters, a head may run
    over several lines (see head_roles(), also for `note`): native stretches
    are the name, Latin ones name_en. Credits are then those within the head,
    else a line of credits alone, else from hours of either; a head line of
    nothing else says credits for sure, and so does a 0 before hours. The
    description is native lines only.
    """
    has = lambda c: c in lines.columns
    blocks = _block_parts(lines, label, most, native, note)
    codes = F.filter(F.split(F.concat_ws(" ", F.col("__said"), F.col("__listed")), " "), lambda x: x != "")
    blocks = blocks.withColumn("prerequisite", F.array_join(F.array_sort(F.array_distinct(codes)), " "))
    alone = F.struct(F.coalesce(F.get("__heads", F.lit(0)), F.lit("")).alias("name"), F.lit("").alias("name_en"))
    blocks = _with_head_names(blocks, native) if native else blocks.withColumn("__two", alone)
    blocks = blocks.withColumn("__head", F.col("__two.name")).withColumn("__stem", f.stem_and_number(F.col("__head")))
    alike = Window.partitionBy("doc_id", "__stem.stem")
    numbered = F.when(F.col("__stem.number").isNotNull(), F.col("code"))
    joined = blocks.withColumn("__alone", F.min(numbered).over(alike) == F.max(numbered).over(alike))
    paid = F.col("__alone") & (F.col("__stem.number").cast("string") == F.regexp_extract("__derived", "^([0-9]+)", 1))
    if native:
        paid = paid & F.col("__told").isNull()
    name = F.when(F.coalesce(paid, F.lit(False)), F.trim(F.regexp_replace("__head", "[0-9]+$", ""))).otherwise(F.col("__head"))
    told = joined.withColumns({"name": name, "name_en": F.col("__two.name_en")})
    if not native:
        told = told.withColumn("__two", f.split_bilingual_name(F.col("name")))
        both = (F.col("__two.first") != "") & (F.col("__two.second") != "")
        told = told.withColumns({"name": F.when(both, F.col("__two.first")).otherwise(F.col("name")), "name_en": F.when(both, F.col("__two.second"))})
    filled = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("block"))).alias(c)
    pages = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages")] if has("page_no") else []
    kept = ("name", "name_en", "credits", "prerequisite", "description", *(c for c in ("category", "group") if has(c)))
    return told.groupBy("doc_id", "code").agg(*map(filled, kept), F.count("*").alias("n_blocks"), *pages)


def repair_credits(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Credits from what is printed by code (doc_id, code, usable, first): a blank or bare number takes the first printed triple,
    an inferred value or one that differs takes the only printed one. rule tells which, and keeps the row from R16.
    """
    joined = rows.join(printed.select("doc_id", "code", "usable", F.col("first").alias("__first")), ["doc_id", "code"], "left")
    bare = F.coalesce(F.col("credits"), F.lit("")).rlike(r"^\s*[0-9]*\s*$")
    rule = F.when(bare & F.col("__first").isNotNull(), "blank").when(F.col("inferred") & F.col("usable").isNotNull(), "inferred").when(F.col("usable").isNotNull() & (F.col("credits") != F.col("usable")), "differs")
    value = F.when(rule == "blank", F.col("__first")).when(rule.isNotNull(), F.col("usable")).otherwise(F.col("credits"))
    return joined.select(*(c for c in rows.columns if c != "credits"), value.alias("credits"), rule.alias("rule"))


def _triples(c) -> Column:
    """Credits with hours, in order, without white space."""
    return F.regexp_extract_all(F.regexp_replace(c, r"\s+", ""), F.lit(r"[0-9]{1,2}\([0-9xX]+-[0-9xX]+-[0-9xX]+\)"), F.lit(0))


def credits_from_header(rows: DataFrame, cells: DataFrame, printed: DataFrame) -> DataFrame:
    """R15, header cells: empty credits of rows (doc_id, code, credits) from tables whose credits slipped into the first row.

    cells(doc_id, page_no, table_no, row_no, cells). If a cell of row 0 holds
    two credits or more and just as many later rows begin with a code and have
    none, they are paired in order. A code that is printed with credits
    elsewhere (printed: doc_id, code) is left. rule is header where it applied.
    """
    table = ["doc_id", "page_no", "table_no"]
    head = cells.filter("row_no = 0").select(*table, F.posexplode("cells").alias("at", "c")).select(*table, "at", _triples("c").alias("v")).filter(F.size("v") >= 2).groupBy(*table).agg(F.max_by("v", "at").alias("v"))
    first = F.regexp_replace(F.coalesce(F.get("cells", F.lit(0)), F.lit("")), r"\s+", "")
    empty = ~F.exists("cells", lambda c: F.size(_triples(F.coalesce(c, F.lit("")))) > 0)
    w = Window.partitionBy(*table)
    bare = cells.filter("row_no > 0").filter(first.rlike("^[0-9]{8}$") & empty).select(*table, "row_no", first.alias("code")).withColumns({"__nth": F.row_number().over(w.orderBy("row_no")), "__n": F.count("*").over(w)})
    paired = bare.join(head, table).filter(F.size("v") == F.col("__n")).withColumn("__v", F.get("v", F.col("__nth") - 1))
    one = paired.groupBy("doc_id", "code").agg(F.min_by("__v", F.struct("page_no", "table_no", "row_no")).alias("__v")).join(printed.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti")
    joined = rows.join(one, ["doc_id", "code"], "left")
    takes = (F.trim(F.coalesce("credits", F.lit(""))) == "") & F.col("__v").isNotNull()
    return joined.withColumns({"rule": F.when(takes, "header"), "credits": F.when(takes, F.col("__v")).otherwise(F.col("credits"))}).drop("__v")


def credits_by_name(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """R15, several values: rows (doc_id, name, credits) with more than one credits or an "or" take the one printed beside their name.

    printed(doc_id, name, credits). All single values of the name, white space
    aside, must agree; a name that is printed with an "or" between all its
    credits is a choice and left. rule is name where it applied.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    says_or = F.coalesce(F.col("credits").rlike(r"(?i)\bor\b|หรือ"), F.lit(False))
    own = printed.select("doc_id", bare(F.col("name")).alias("__key"), _triples("credits").alias("__v"), says_or.alias("__or"), F.split("credits", r"[0-9]{1,2}\s*\([0-9xX\s-]+\)").alias("__gaps")).filter("__key <> ''")
    between = F.slice("__gaps", F.lit(2), F.size("__gaps") - 2)
    choice = (F.size("__v") >= 2) & F.forall(between, lambda g: g.rlike(r"(?i)\bor\b|หรือ"))
    single = F.when((F.size("__v") == 1) & ~F.col("__or"), F.get("__v", F.lit(0)))
    told = own.groupBy("doc_id", "__key").agg(F.max(F.coalesce(F.when(F.size("__v") >= 2, choice), F.lit(False))).alias("__choice"), F.min(single).alias("__one"), F.max(single).alias("__last")).filter("not __choice and __one = __last")
    joined = rows.withColumn("__key", bare(F.col("name"))).join(told.select("doc_id", "__key", "__one"), ["doc_id", "__key"], "left")
    takes = F.col("__one").isNotNull() & ((F.size(F.array_distinct(_triples("credits"))) >= 2) | says_or)
    takes = F.coalesce(takes, F.lit(False))
    return joined.withColumns({"rule": F.when(takes, "name"), "credits": F.when(takes, F.col("__one")).otherwise(F.col("credits"))}).drop("__key", "__one")


def fill_second_name(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """An empty second name of a real code becomes the printed one, if all printings of the code agree."""
    agreed = printed.filter("name_en <> ''").groupBy("doc_id", "code").agg(F.when(F.count_distinct("name_en") == 1, F.min("name_en")).alias("__en"))
    joined = rows.join(agreed, ["doc_id", "code"], "left")
    empty = (F.coalesce("name_en", F.lit("")) == "") & F.col("code").rlike("^[0-9]{8}$")
    return joined.withColumn("name_en", F.when(empty, F.coalesce("__en", "name_en")).otherwise(F.col("name_en"))).select(*rows.columns)


def strip_credit_digit(rows: DataFrame, docs: DataFrame, printed: DataFrame) -> DataFrame:
    """Rows (doc_id, ordinal, code, name_en, credits) whose second name ends with its own credits as a word, without it.

    Only if the text (doc_id, text) prints the name with the row's hours right
    after it, and the whole name nowhere as a line or cell by itself. Where
    tables (doc_id, code, name_en) print just one name of the code that is
    the cut one with a number, that is taken. note tells the name before. A
    name is found by its last two words and the hours, then compared whole.
    """
    tidy = lambda c: F.trim(F.regexp_replace(c, r"[\s*]+", " "))
    hours = r"\(\s*[0-9]+\s*-\s*[0-9]+\s*-\s*[0-9]+\s*\)"
    two = lambda c: F.array_join(F.slice(F.split(c, " "), -2, 2), " ")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    words = F.split("__name", " ")
    own = rows.select("doc_id", "ordinal", "code", tidy(F.col("name_en")).alias("__name"), F.regexp_extract(bare(F.col("credits")), r"^([0-9]+)\(", 1).alias("__c"), F.regexp_extract(bare(F.col("credits")), r"^[0-9]+(\(.*\))$", 1).alias("__h"))
    asked = own.filter((F.col("__c") != "") & (F.size(words) >= 2) & (F.element_at(words, -1) == F.col("__c"))).withColumn("__two", two(F.col("__name")))
    flat = F.regexp_replace("text", "<[^>]+>", " ")
    said = docs.select("doc_id", F.explode(F.arrays_zip(F.split(flat, hours).alias("before"), F.regexp_extract_all(flat, F.lit(hours), F.lit(0)).alias("hours"))).alias("x")).filter("x.hours is not null")
    said = said.select("doc_id", F.trim(F.regexp_replace("x.before", r"\s+", " ")).alias("__before"), bare(F.col("x.hours")).alias("__h")).withColumn("__two", two(F.col("__before")))
    left = F.substr("__before", F.lit(1), F.length("__before") - F.length("__name"))
    together = asked.join(said, ["doc_id", "__two", "__h"]).filter(F.endswith("__before", F.col("__name")) & ~left.rlike(r"[\w-]$")).select("doc_id", "ordinal", "code", "__name").distinct()
    lines = docs.select("doc_id", F.explode(F.split(F.regexp_replace("text", "<[^>]+>", "\n"), "\n")).alias("l")).select("doc_id", tidy(F.col("l")).alias("__name")).distinct()
    cut = together.join(lines, ["doc_id", "__name"], "left_anti").withColumn("__cut", F.regexp_replace("__name", " [0-9]+$", ""))
    named = printed.select("doc_id", "code", tidy(F.col("name_en")).alias("__full")).filter(F.col("__full").rlike(" [0-9]+$")).withColumn("__cut", F.regexp_replace("__full", " [0-9]+$", ""))
    series = named.groupBy("doc_id", "code", "__cut").agg(F.when(F.count_distinct("__full") == 1, F.min("__full")).alias("__full"))
    found = cut.join(series, ["doc_id", "code", "__cut"], "left").select("doc_id", "ordinal", F.coalesce("__full", "__cut").alias("__new"))
    joined = rows.join(found, ["doc_id", "ordinal"], "left").withColumn("note", F.when(F.col("__new").isNotNull(), F.concat(F.lit("credits at the end of "), "name_en")))
    return joined.withColumn("name_en", F.coalesce("__new", "name_en")).drop("__new")


def recover_alternatives(options: DataFrame, rows: DataFrame) -> DataFrame:
    """Options (doc_id, page, grp, code, name) of a table group that the rows lack, with term and group of the sibling on the nearest page; ties to the earlier row, then by name."""
    missing = options.join(rows.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti")
    other = options.select("doc_id", "page", "grp", F.col("code").alias("sibling"))
    near = rows.select("doc_id", F.col("code").alias("sibling"), F.col("page").alias("__page"), "ordinal", "year", "semester", "alt_group")
    joined = missing.join(other, ["doc_id", "page", "grp"]).join(near, ["doc_id", "sibling"])
    best = F.row_number().over(Window.partitionBy("doc_id", "page", "grp", "code").orderBy(F.abs(F.col("__page") - F.col("page")), "ordinal", "name"))
    return joined.withColumn("__n", best).filter("__n = 1").select("doc_id", "page", "code", "name", "year", "semester", "alt_group")


def group_cell_codes(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Two or more ungrouped rows of one page and term whose codes one cell lists become a group, unless some group has just those codes."""
    each = cells.select("doc_id", "page", "cell", F.array_sort(F.array_distinct("codes")).alias("codes")).withColumn("code", F.explode("codes"))
    free = rows.filter("alt_group is null").select("doc_id", "page", "code", "ordinal", (F.col("year") * 10 + F.col("semester")).alias("term"))
    met = each.join(free, ["doc_id", "page", "code"])
    whole = met.groupBy("doc_id", "page", "cell", "codes").agg(F.count("*").alias("n"), F.min("term").alias("lo"), F.max("term").alias("hi")).filter("n >= 2 and lo = hi")
    held = rows.filter("alt_group is not null").groupBy("doc_id", "alt_group").agg(F.array_sort(F.collect_set("code")).alias("codes")).select("doc_id", "codes")
    fresh = whole.join(held, ["doc_id", "codes"], "left_anti").select("doc_id", "page", "cell")
    named = met.join(fresh, ["doc_id", "page", "cell"]).groupBy("doc_id", "ordinal").agg(F.min(F.concat_ws("-", F.lit("cell"), "page", "cell")).alias("__g"))
    return rows.join(named, ["doc_id", "ordinal"], "left").withColumn("alt_group", F.coalesce("alt_group", "__g")).select(*rows.columns)


def term_from_cell(rows: DataFrame, cells: DataFrame, least: int = 10) -> DataFrame:
    """A row without a term whose name is one entry of one cell takes the term that the cell's other codes agree on. cells(doc_id, cell, code, name)."""
    lost = rows.filter(F.col("year").isNull() & (F.length("name") >= least)).select("doc_id", "name").distinct()
    entry = lost.join(cells.select("doc_id", "cell", "name"), ["doc_id", "name"]).groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.min("cell").alias("cell")).filter("n = 1")
    placed = cells.select("doc_id", "cell", "code").join(rows.filter("year is not null").select("doc_id", "code", "year", "semester").distinct(), ["doc_id", "code"])
    agreed = placed.groupBy("doc_id", "cell").agg(F.min(F.struct("year", "semester")).alias("t"), F.max(F.struct("year", "semester")).alias("__t")).filter("t = __t")
    found = entry.join(agreed, ["doc_id", "cell"]).select("doc_id", "name", "t")
    joined = rows.join(found, ["doc_id", "name"], "left")
    lacks = F.col("year").isNull()
    return joined.withColumns({"semester": F.when(lacks, F.col("t.semester")).otherwise(F.col("semester")), "year": F.coalesce("year", "t.year")}).select(*rows.columns)


def split_by_variant(rows: DataFrame, spans: DataFrame, steps) -> tuple[DataFrame, DataFrame]:
    """Repair steps in order, then a row goes to the sections that hold its page; also counts by section."""
    for step in steps:
        rows = step(rows)
    routed = assign_section(rows, spans)
    return routed, routed.groupBy("doc_id", "section").agg(F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_codes"))


def convert_documents(
    pages: DataFrame, heading: str = r"(?i)year\s*([0-9]+)\s*semester\s*([0-9]+|summer)", description: str = r"^[0-9]{8}\b", follow: str = r"(?i)^prerequisite\s*:", variant: str | None = r"(?i)plan (without )?co-?op"
) -> dict[str, DataFrame]:
    """Pages (doc_id, page_no, text) of marked documents to the tables of convert_rows(), `rows`, the repaired rows, `log`, what each repair changed, and `skipped`, the tables without a term.

    In the order of the reference: tables with the heading in force (T1, T3,
    T5), merged rows (T4), rows and alternatives (T7, T8), description blocks
    (D1, D2); then codes by name (R4), mixed groups (R24), names by vote (R7),
    credits from descriptions and series (R13), prerequisites; last the tables
    (R3). A document is the scope; text on pages in no table is only read for
    descriptions. What tables and descriptions hold is written once, as the
    repairs read it often.
    """
    tables = explode_tables(pages)
    read = written(grid_rows(tables), "grids")
    terms = written(table_terms(pages, read, heading, variant), "terms")
    known_terms = terms.filter("year is not null and semester is not null")
    table = ["doc_id", "page_no", "table_no"]
    lines_of = normalize_grid_rows(read)
    entries = written(assign_alt_groups(group_entries(group_rowspan_rows(lines_of)), known_terms.drop("variant")).join(known_terms.select(*table, "variant"), table), "entries")
    lines = pages.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"(?is)<table.*?</table>", ""), "\n")).alias("at", "line"), "page_no").select("doc_id", (F.col("page_no") * 1_000_000 + F.col("at")).alias("line_no"), F.trim("line").alias("line"))
    described = written(parse_blocks(description_blocks(lines, description, follow, bare=r"^[0-9]{8}\s*$")), "described")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "table_no", "grp", "entry"))
    rows = entries.withColumn("ordinal", place.cast("long")).withColumn("category", F.lit(None).cast("string"))
    per_doc = lambda c: F.concat_ws("|", F.col("doc_id").cast("string"), c)

    def names_by_vote(rows: DataFrame) -> DataFrame:
        named = rows.select(per_doc(F.col("code")).alias("code"), "name", F.lit("table").alias("source")).filter("code is not null").unionByName(described.select(per_doc(F.col("code")).alias("code"), "name", F.lit("description").alias("source")))
        voted = repair.vote_names(named).select(F.col("code").alias("__key"), F.col("name").alias("__name"))
        return rows.withColumn("__key", F.when(F.col("code").isNotNull(), per_doc(F.col("code")))).join(voted, "__key", "left").withColumn("name", F.coalesce("__name", "name")).drop("__key", "__name")

    def described_credits(rows: DataFrame) -> DataFrame:
        given = described.select("doc_id", "code", F.col("credits").alias("__credits"), F.col("prerequisite").alias("__prerequisite"))
        filled = F.coalesce(F.nullif("credits", F.lit("")), F.nullif("__credits", F.lit("")))
        return rows.join(given, ["doc_id", "code"], "left").withColumns({"credits": filled, "prerequisite": F.col("__prerequisite")}).drop("__credits", "__prerequisite")

    steps = [
        ("R4", lambda r: repair.recover_codes(r, described.select("doc_id", "name", "code"), scope=["doc_id"]).drop("note", "recovered")),
        ("R24", lambda r: repair.dissolve_mixed_groups(r, ["doc_id", "year", "semester"])),
        ("R7", names_by_vote),
        ("D4", described_credits),
        ("R13", lambda r: repair.impute_from_series(r, ["doc_id"])),
    ]
    rows, log = with_log(rows.withColumn("prerequisite", F.lit(None).cast("string")), steps, ["doc_id", "ordinal"])
    skipped = skipped_tables(lines_of.join(terms, table))
    return {"rows": rows, "log": log, "skipped": skipped, **convert_rows(rows, ["doc_id"])}
