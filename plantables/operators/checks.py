"""Data-quality checks over plan, course and prerequisite tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantables.functions.text import course_codes
from plantables.operators.views import SCOPE, TERM, semester_credits

REAL = "^[0-9]{8}$"
#: Terms of one of these are blocks, whose load isn't checked.
BLOCK_WORDS = "(?i)intern|coop|practicum"


def total_credits(plan: DataFrame, program: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Computed against declared totals by scope, with slots whose `counted` holds; a scope without a plan and a declared 0 passes."""
    made = semester_credits(plan).groupBy(*SCOPE).agg(F.sum("credits").alias("computed"))
    if slots is not None:
        made = made.unionByName(slots.filter("counted").groupBy(*SCOPE).agg(F.sum("credits").cast("long").alias("computed"))).groupBy(*SCOPE).agg(F.sum("computed").alias("computed"))
    joined = program.join(made, SCOPE, "left").join(plan.select(*SCOPE, F.lit(True).alias("__planned")).distinct(), SCOPE, "left")
    catalog = F.col("__planned").isNull() & (F.col("total_credits") == 0)
    joined = joined.withColumn("computed", F.coalesce("computed", F.lit(0).cast("long")))
    return joined.select(*SCOPE, "total_credits", "computed", ((F.col("total_credits") == F.col("computed")) | catalog).alias("ok"))


def orphans(plan: DataFrame, course: DataFrame) -> DataFrame:
    """Plan codes without a course."""
    return plan.select(*SCOPE, "code").distinct().join(course.select("code"), "code", "left_anti").select(*SCOPE, "code")


def bad_codes(*tables: DataFrame) -> DataFrame:
    """Codes of any table that are neither a placeholder nor eight digits."""
    codes = reduce(DataFrame.unionByName, (t.select("code") for t in tables)).distinct()
    return codes.filter(~F.col("code").rlike(REAL) & ~F.col("code").startswith("PLACEHOLDER_"))


def credit_mismatch(plan: DataFrame, course: DataFrame) -> DataFrame:
    """C4: plan rows whose credits differ from the course's; unknown ones never do."""
    c = course.select("code", F.col("credits").alias("course_credits"))
    return plan.join(c, "code").filter("credits <> course_credits").select(*SCOPE, "id", "code", "credits", "course_credits")


def prerequisite_order(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of placements in one scope where the required course isn't earlier than the course; each pair of terms once."""
    placed = plan.select(*SCOPE, "code", (F.col("year") * 10 + F.col("semester")).alias("at")).distinct()
    pre = edges.filter("kind = 'pre' and code <> requires").select("code", "requires").distinct()
    needs = placed.withColumnsRenamed({"code": "requires", "at": "requires_at"})
    return placed.join(pre, "code").join(needs, [*SCOPE, "requires"]).filter("requires_at >= at").select(*SCOPE, "code", "requires", "at", "requires_at")


def duplicates_in_term(plan: DataFrame) -> DataFrame:
    """Codes that a term has more than once outside alternatives."""
    return plan.filter("alt_group is null").groupBy(*TERM, "code").agg(F.count("*").alias("n")).filter("n > 1")


def term_load(plan: DataFrame, least: int = 9, most: int = 22, words: list[str] | None = None) -> DataFrame:
    """Terms 1 and 2 whose credits are out of bounds, but for block terms: a course of 6 credits or more, or a block word
    in one of the columns `words` (category, and note, type and names where the rows have them)."""
    asked = words if words is not None else [c for c in ("category", "type", "note", "name_th", "name_en") if c in plan.columns]
    said = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike(BLOCK_WORDS), F.lit(False)) for c in asked), F.lit(False))
    block = plan.filter((F.col("credits") >= 6) | said).select(*TERM).distinct()
    load = semester_credits(plan).filter("semester <> 3").join(block, TERM, "left_anti")
    return load.filter(~F.col("credits").between(least, most)).select(*TERM, "credits")


#: Forms that codes and credits of extracted rows have.
ROW_CODE, ROW_CREDITS = r"^([0-9xX]{8}|PLACEHOLDER_[0-9]+X+)$", r"^[0-9]{1,2}\([0-9xX]{1,2}-[0-9xX]{1,2}-[0-9xX]{1,2}\)$"


def row_rules(rows: DataFrame, by: list[str], categories: list[str], types: list[str]) -> DataFrame:
    """Extracted rows (by, ordinal, code, credits, category, type, year, semester, flexible, name_th, name_en, prerequisite)
    -> ordinal and rule for each rule that a row breaks.

    code: each alternative is eight digits or x; credits: the form, unless it
    holds an "or"; category, type: one of those given; flexible: a row without
    year and semester needs its terms, where the document has years at all;
    fixed: a row with a year has none; name: Latin capitals in the first name;
    credits in name: in the second; prerequisite: a code that no row has.
    Empty values break nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    codes = F.filter(F.transform(F.split(text("code"), r"(?i)\bor\b|หรือ|/"), lambda x: F.trim(x)), lambda x: x != "")
    own = rows.withColumns({"__codes": codes, "__flexible": text("flexible") != ""})
    dated = rows.filter("coalesce(year, 0) <> 0").select(*by).distinct().withColumn("__dated", F.lit(True))
    held = own.select(*by, F.explode("__codes").alias("__pre")).distinct()
    asked = own.select(*by, "ordinal", F.explode(course_codes(F.col("prerequisite"))).alias("__pre"))
    lost = asked.join(held, [*by, "__pre"], "left_anti").select(*by, "ordinal").distinct().withColumn("__lost", F.lit(True))
    joined = own.join(dated, by, "left").join(lost, [*by, "ordinal"], "left")
    timeless = (F.coalesce("year", F.lit(0)) == 0) & (F.coalesce("semester", F.lit(0)) == 0)
    credits = F.regexp_replace(text("credits"), r"\s+", "")
    broken = [
        F.when(~F.forall("__codes", lambda x: x.rlike(ROW_CODE)) | (F.size("__codes") == 0), "code"),
        F.when((credits != "") & ~credits.rlike(ROW_CREDITS) & ~text("credits").rlike(r"(?i)\bor\b|หรือ"), "credits"),
        F.when((text("category") != "") & ~text("category").isin(categories), "category"),
        F.when((text("type") != "") & ~text("type").isin(types), "type"),
        F.when(timeless & ~F.col("__flexible") & F.col("__dated"), "flexible"),
        F.when((F.coalesce("year", F.lit(0)) != 0) & F.col("__flexible"), "fixed"),
        F.when(text("name_th").rlike("[A-Z]"), "name"),
        F.when(text("name_en").rlike(r"[0-9]{1,2}\s*\([0-9xX]+-[0-9xX]+-[0-9xX]+\)"), "credits in name"),
        F.when(F.col("__lost"), "prerequisite"),
    ]
    return joined.select("ordinal", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def term_bounds(plan: DataFrame, least: int = 9, most: int = 25) -> DataFrame:
    """Terms below or above the bounds, an alternative counted once by its largest credits."""
    group = F.coalesce("alt_group", F.concat(F.lit("x"), F.col("id")))
    once = plan.groupBy(*TERM, group.alias("g")).agg(F.max("credits").alias("credits"))
    total = once.groupBy(*TERM).agg(F.sum("credits").alias("credits"), F.max("credits").alias("largest"))
    fault = F.when(F.col("credits") > most, "above").when((F.col("credits") < least) & (F.col("largest") < 6), "below")
    return total.select(*TERM, "credits", fault.alias("fault")).filter("fault is not null")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def report(found: dict[str, DataFrame], scopes: DataFrame, examples: int = 5) -> DataFrame:
    """C11: a row for each scope and check: whether it is clean, how many faults, and the first few as text.

    found: by check, rows of scope and `example`. Only the smallest few
    examples of a scope are gathered.
    """
    rows = reduce(DataFrame.unionByName, (df.select(*SCOPE, F.lit(k).alias("check"), "example") for k, df in found.items()))
    first = Window.partitionBy(*SCOPE, "check").orderBy("example")
    few = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= examples)
    text = few.groupBy(*SCOPE, "check").agg(F.array_join(F.array_sort(F.collect_list("example")), "; ").alias("detail"))
    counts = rows.groupBy(*SCOPE, "check").agg(F.count("*").alias("n"))
    every = scopes.select(*SCOPE).distinct().withColumn("check", F.explode(F.array(*map(F.lit, found))))
    joined = every.join(counts, [*SCOPE, "check"], "left").join(text, [*SCOPE, "check"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select(*SCOPE, "check", (n == 0).alias("ok"), n.alias("n"), F.coalesce("detail", F.lit("")).alias("detail"))


def every_check(plan: DataFrame, course: DataFrame, program: DataFrame, edges: DataFrame | None = None, slots: DataFrame | None = None, load: tuple[int, int] = (9, 22), bounds: tuple[int, int] = (9, 25)) -> dict[str, DataFrame]:
    """C11: the faults of all checks of a plan, by check, as report() takes them: scope and `example`.

    program has the declared total_credits. Without edges no order is checked.
    """

    def told(faults: DataFrame, *columns: str) -> DataFrame:
        return faults.select(*SCOPE, F.concat_ws("/", *columns).alias("example"))

    found = {
        "CHK0": told(program_present(plan, program), "program"),
        "CHK1": told(total_credits(plan, program, slots).filter("not ok"), "total_credits", "computed"),
        "CHK2": told(orphans(plan, course), "code"),
        "CHK3": told(plan.select(*SCOPE, "code").distinct().join(bad_codes(plan), "code"), "code"),
        "CHK4": told(credit_mismatch(plan, course), "id", "credits", "course_credits"),
        "CHK6": told(duplicates_in_term(plan), "year", "semester", "code"),
        "CHK7": told(term_load(plan, *load), "year", "semester", "credits"),
        "CHK9": told(term_bounds(plan, *bounds), "year", "semester", "fault"),
        "CHK13": told(missing_terms(plan), "year", "semester"),
    }
    return found | ({"CHK5": told(prerequisite_order(plan, edges), "code", "requires")} if edges is not None else {})


def missing_terms(plan: DataFrame) -> DataFrame:
    """Years up to the last and semesters 1 and 2 that a scope doesn't have."""
    years = plan.groupBy(*SCOPE).agg(F.max("year").alias("last")).withColumn("year", F.explode(F.sequence(F.lit(1), F.col("last"))))
    every = years.withColumn("semester", F.explode(F.array(F.lit(1), F.lit(2)))).select(*TERM)
    return every.join(plan.select(*TERM).distinct(), TERM, "left_anti")


def ranges_differ(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """C14: pages that one of two registries of ranges (first, last) covers and the other doesn't."""

    def pages(df: DataFrame) -> DataFrame:
        return df.select(*key, F.explode(F.sequence("first", "last")).alias("page")).distinct()

    left, right = pages(a).withColumn("l", F.lit(1)), pages(b).withColumn("r", F.lit(1))
    both = left.join(right, [*key, "page"], "full").filter("l is null or r is null")
    return both.select(*key, "page", F.when(F.col("l") == 1, "first_only").otherwise("second_only").alias("side"))


def student_plans(lines: DataFrame, known: DataFrame, edges: DataFrame, cap: int = 22, completed: DataFrame | None = None, approved: DataFrame | None = None) -> DataFrame:
    """Planned lines (student, term, code, credits) -> faults by student and code: unknown, repeated, cap, order, duplicate term.

    A course counts from its earliest place in plan and record together: what
    is completed (student, code), or approved as equivalent (student, code),
    is so before all terms. A required course must be earlier. With a column
    entry, which tells the lists that a plan is given in, a term in several
    lists is a fault of its own, under the term's number, and its credits
    aren't added up.
    """
    unknown = lines.join(known.select("code"), "code", "left_anti").select("student", "code", F.lit("unknown").alias("fault"))
    repeated = lines.groupBy("student", "code").agg(F.count("*").alias("n")).filter("n > 1").select("student", "code", F.lit("repeated").alias("fault"))
    entries = F.count_distinct("entry") if "entry" in lines.columns else F.lit(1)
    terms = lines.groupBy("student", "term").agg(F.sum("credits").alias("n"), entries.alias("entries"))
    fault = F.when(F.col("entries") > 1, "duplicate term").when(F.col("n") > cap, "cap")
    over = terms.select("student", F.col("term").cast("string").alias("code"), fault.alias("fault")).filter("fault is not null")
    at = lines.select("student", "code", "term")
    for record in (completed, approved):
        if record is not None:
            at = at.unionByName(record.select("student", "code", F.lit(None).cast(lines.schema["term"].dataType).alias("term")))
    # null is before all terms
    earliest = at.groupBy("student", "code").agg(F.min("term").alias("at"), F.max(F.col("term").isNull()).alias("done"))
    pre = edges.filter("kind = 'pre' and code <> requires").select("code", "requires").distinct()
    planned = lines.groupBy("student", "code").agg(F.min("term").alias("at"))
    before = earliest.withColumnsRenamed({"code": "requires", "at": "before"})
    order = planned.join(pre, "code").join(before, ["student", "requires"], "left").filter("not coalesce(done, false) and (before is null or before >= at)").select("student", "code", F.lit("order").alias("fault")).distinct()
    return unknown.distinct().unionByName(repeated).unionByName(over).unionByName(order)


def program_present(plan: DataFrame, program: DataFrame) -> DataFrame:
    """Scopes that have plan rows but no program row."""
    return plan.select(*SCOPE).distinct().join(program.select(*SCOPE), SCOPE, "left_anti")
