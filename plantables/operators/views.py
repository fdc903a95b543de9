"""Relational views over course, plan, prerequisite and slot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantables.functions.text import category_class, format_credits

SCOPE = ["program", "edition", "track"]
TERM = [*SCOPE, "year", "semester"]


def plan_view(plan: DataFrame, course: DataFrame) -> DataFrame:
    """V1: plan rows with course names; pages are the plan's, else the course's."""
    c = course.select("code", "name_th", "name_en", F.col("pages").alias("course_pages"))
    return plan.join(c, "code", "left").withColumn("pages", F.coalesce("pages", "course_pages")).drop("course_pages")


def course_terms(plan: DataFrame, slots: DataFrame, course: DataFrame) -> DataFrame:
    """V2: scheduled rows and flexible slots; a slot has no year or semester."""
    c = course.select("code", "name_th", F.col("credits").alias("course_credits"))
    fixed = plan.select(*TERM, "code", "credits", F.lit(None).cast("string").alias("allowed_terms")).join(c, "code", "left")
    free = slots.select(*SCOPE, F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("semester"), "code", "credits", "allowed_terms").join(c, "code", "left")
    both = fixed.unionByName(free)
    return both.select(*TERM, "code", "name_th", F.coalesce("credits", "course_credits").alias("credits"), "allowed_terms")


def alternatives_once(plan: DataFrame, *more: str) -> DataFrame:
    """The least credits of each alternative group of a term; a row without a group is one by itself."""
    group = F.coalesce("alt_group", F.concat(F.lit("x"), F.col("id")))
    return plan.groupBy(*TERM, *more, group.alias("grp")).agg(F.min("credits").alias("credits"))


def semester_credits(plan: DataFrame) -> DataFrame:
    """V3: credits and course count by term, an alternative counted once."""
    return alternatives_once(plan).groupBy(*TERM).agg(F.sum("credits").alias("credits"), F.count("*").alias("n_courses"))


def year_credits(plan: DataFrame) -> DataFrame:
    """V4: V3 summed by year."""
    return semester_credits(plan).groupBy(*SCOPE, "year").agg(F.sum("credits").alias("credits"))


def category_credits(plan: DataFrame) -> DataFrame:
    """V5: credits by category and type, an alternative counted once in each."""
    return alternatives_once(plan, "category", "type").groupBy(*SCOPE, "category", "type").agg(F.sum("credits").alias("credits"))


def prerequisite_view(edges: DataFrame, course: DataFrame) -> DataFrame:
    """V6: edges with both names."""
    a = course.select("code", F.col("name_th").alias("name"))
    b = course.select(F.col("code").alias("requires"), F.col("name_th").alias("requires_name"))
    return edges.join(a, "code", "left").join(b, "requires", "left").select("code", "name", "requires", "requires_name", "kind")


def unlocks_view(edges: DataFrame, course: DataFrame) -> DataFrame:
    """V7: V6 read the other way."""
    return prerequisite_view(edges, course).select(F.col("requires").alias("code"), F.col("requires_name").alias("name"), F.col("code").alias("unlocks"), F.col("name").alias("unlocks_name"), "kind")


def real_courses(course: DataFrame) -> DataFrame:
    """V8: rows whose code is eight digits."""
    return course.filter(F.col("code").rlike("^[0-9]{8}$"))


def prerequisite_stats(course: DataFrame, edges: DataFrame) -> DataFrame:
    """V9: courses required and unlocked, of kind 'pre', distinct; 0 where there are none."""
    pre = edges.filter("kind = 'pre'")
    needs = pre.groupBy("code").agg(F.count_distinct("requires").alias("n_requires"))
    opens = pre.groupBy(F.col("requires").alias("code")).agg(F.count_distinct("code").alias("n_unlocks"))
    joined = course.select("code").join(needs, "code", "left").join(opens, "code", "left")
    return joined.select("code", F.coalesce("n_requires", F.lit(0)).alias("n_requires"), F.coalesce("n_unlocks", F.lit(0)).alias("n_unlocks"))


#: Words that a short name does without, before and after.
NAME_PREFIX = r"^(?:หลักการ|พื้นฐาน|เบื้องต้นเกี่ยวกับ|ความรู้เบื้องต้นเกี่ยวกับ)\s*"
NAME_SUFFIX = r"\s*(?:เบื้องต้น|ขั้นพื้นฐาน)$"

HOURS = ["lecture_h", "lab_h", "self_h"]


def qa_course(course: DataFrame) -> DataFrame:
    """Flat rows of real courses with their pages; null is unknown."""
    return real_courses(course).select("code", "name_th", "name_en", "credits", *HOURS, F.col("pages").alias("course_pages"))


def qa_plan(plan: DataFrame, course: DataFrame) -> DataFrame:
    """Flat distinct plan rows of real courses, with the pages of both owners; credits are the plan's, else the course's."""
    c = course.select("code", "name_th", "name_en", F.col("credits").alias("course_credits"), *HOURS, F.col("pages").alias("course_pages"))
    joined = real_courses(plan).withColumnRenamed("pages", "plan_pages").join(c, "code", "left")
    credits = F.coalesce("credits", "course_credits").alias("credits")
    return joined.select(*TERM, "code", "name_th", "name_en", credits, *HOURS, "category", "type", "alt_group", "course_pages", "plan_pages").distinct()


def qa_program(program: DataFrame) -> DataFrame:
    """What is recorded of a program, and nothing on who may graduate."""
    return program.select("program_id", "name_th", "name_en", "degree", "total_credits", "years")


def flatten_prediction(course: DataFrame, plan: DataFrame, edges: DataFrame, slots: DataFrame) -> DataFrame:
    """Plan, slots and courses folded back to one row a scope and code; a course in neither has no scope.

    Term, category and type are the first in the plan that aren't empty, else
    the slot's; the term is 0 where there is none. Slots give their terms and
    a name to codes without a course. Credits are text with the hours, where
    all are known; prerequisites are the codes that edges require.
    """
    at = F.struct("year", "semester", "id")
    first_of = lambda c: F.min_by(c, F.when(F.col(c) != "", at)).alias(c)
    planned = plan.groupBy(*SCOPE, "code").agg(F.min(at).alias("p"), first_of("category"), first_of("type"))
    slot = slots.groupBy(*SCOPE, "code").agg(*(F.min(F.when(F.col(c) != "", F.col(c))).alias(n) for c, n in (("category", "__category"), ("type", "__type"), ("name_th", "__name"), ("allowed_terms", "allowed_terms"))))
    needs = edges.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("requires")), ", ").alias("prerequisite"))
    credits = format_credits(F.col("credits"), *map(F.col, HOURS)).alias("credits")
    both = planned.join(slot, [*SCOPE, "code"], "full").join(course.select("code", "name_th", credits), "code", "full").join(needs, "code", "left")
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d).alias(c)
    return both.select(
        *SCOPE, "code", *(F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in ("year", "semester")), F.coalesce("category", "__category").alias("category"), F.coalesce("type", "__type").alias("type"),
        filled("name_th", F.col("__name")), "credits", "allowed_terms", F.coalesce("prerequisite", F.lit("")).alias("prerequisite"),
    )


def lexicon(course: DataFrame, prefix: str = NAME_PREFIX, suffix: str = NAME_SUFFIX, shortest: int = 6, least: int = 3) -> DataFrame:
    """Names of `least` characters and more, with their codes; and short aliases, of which a word was cut at either end, twice at most.

    An alias that is another course's name has the codes of both.
    """
    cut = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, prefix, ""), suffix, ""))
    shorter = lambda c: F.when(F.length(cut(c)) >= shortest, cut(c))
    names = course.select("code", F.explode(F.array(F.trim("name_th"), F.trim("name_en"))).alias("name")).filter(F.length("name") >= least)
    once = names.withColumn("once", shorter(F.col("name")))
    forms = once.select("code", F.explode(F.array("name", "once", shorter(F.col("once")))).alias("alias")).filter("alias is not null").distinct()
    return forms.groupBy("alias").agg(F.count("*").alias("n_codes"), F.min("code").alias("first_code"), F.array_sort(F.collect_list("code")).alias("codes"))


#: How types are written.
TYPES = {"required": ["บังคับ"], "elective": ["เลือก"]}


def vocabulary(plan: DataFrame, types: dict[str, list[str]] | None = None) -> DataFrame:
    """(field, kind, value): the ways in which each class of categories and each kind of types is written."""
    kind = F.coalesce(*(F.when(F.trim("type").isin(ways), F.lit(k)) for k, ways in (types or TYPES).items()))
    category = plan.select(F.lit("category").alias("field"), category_class(F.col("category")).alias("kind"), F.col("category").alias("value"))
    kinds = plan.select(F.lit("type").alias("field"), kind.alias("kind"), F.col("type").alias("value"))
    return category.unionByName(kinds).filter("kind is not null").distinct()
