"""The query surface: filters, searches, counts, tops, pages of results and set comparisons (Q, E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.operators.views import SCOPE, real_courses


def search_courses(course: DataFrame, term: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Q3: code or a name holds the term, in any case; by code; limit from 1 to 100."""
    pattern = f"%{term}%"
    hit = F.col("code").ilike(pattern) | F.col("name_th").ilike(pattern) | F.col("name_en").ilike(pattern)
    return course.filter(hit).orderBy("code").offset(max(0, offset)).limit(min(100, max(1, limit)))


def term_plan(view: DataFrame, year: int, semester: int) -> DataFrame:
    """Q4: the rows of one term, by scope and code."""
    return view.filter((F.col("year") == year) & (F.col("semester") == semester)).orderBy(*SCOPE, "code", "id")


def partial_total(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Q7: sum, mean, least and most of what is known, and how many values aren't; null where none is."""
    c = F.col(column)
    return df.groupBy(*by).agg(
        F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c.isNull()).alias("n_unknown")
    )


def top(df: DataFrame, value: str, key: list[str], k: int, by: list[str] | None = None, with_ties: bool = False) -> DataFrame:
    """Q9: the k rows of largest value, of each group if given; ties by key, or all of them."""
    if not by and not with_ties:
        return df.orderBy(F.desc(value), *key).limit(k)
    order = [F.desc(value)] if with_ties else [F.desc(value), *key]
    rank = (F.rank() if with_ties else F.row_number()).over(Window.partitionBy(*(by or [])).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def not_in(df: DataFrame, column: str, listed: DataFrame, other: str) -> DataFrame:
    """Q11: NOT IN with SQL's nulls: no row if the list holds one; a null value only matches an empty list."""
    has_null = F.broadcast(listed.agg(F.coalesce(F.bool_or(F.col(other).isNull()), F.lit(False)).alias("__null"), F.count("*").alias("__n")))
    rest = df.join(listed.select(F.col(other).alias(column)), column, "left_anti").crossJoin(has_null)
    return rest.filter(~F.col("__null") & (F.col(column).isNotNull() | (F.col("__n") == 0))).drop("__null", "__n").select(*df.columns)


def slots_open_in(slots: DataFrame, term: str) -> DataFrame:
    """Q12: slots whose allowed terms hold this one."""
    return slots.filter(F.array_contains(F.split("allowed_terms", ", *"), term))


def page_result(df: DataFrame, by: list[str], order: list[str], page: int, size: int) -> DataFrame:
    """Q14: one page of each group's rows, with the total and whether more follow."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    totals = df.groupBy(*by).agg(F.count("*").alias("total_count"))
    rows = df.withColumn("__n", rank).filter((F.col("__n") > (page - 1) * size) & (F.col("__n") <= page * size)).drop("__n")
    return rows.join(totals, by).withColumn("has_more", F.col("total_count") > page * size)


def search_relaxed(course: DataFrame, term: str, least: int = 8) -> DataFrame:
    """Q15: rows that hold the term; if there are none and it has `least` characters or more, the term less its last one, then two."""
    forms = [term, *(term[:-n] for n in (1, 2) if len(term) >= least)]
    tiers = reduce(DataFrame.unionByName, (course.filter(F.col("name_en").ilike(f"%{t}%")).withColumn("tier", F.lit(i)) for i, t in enumerate(forms)))
    lowest = F.broadcast(tiers.agg(F.min("tier").alias("tier")))
    return tiers.join(lowest, "tier").select(*course.columns, "tier")


def single_column_answer(df: DataFrame, by: list[str], column: str, ordinal: str) -> DataFrame:
    """Q16: distinct trimmed values in the order first seen, joined; a group's values are few by its key."""
    value = F.trim(F.col(column).cast("string"))
    first = df.filter(value.isNotNull() & (value != "")).groupBy(*by, value.alias("value")).agg(F.min(ordinal).alias("at"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), ", ").alias("answer"))


def code_tally(df: DataFrame, by: list[str]) -> DataFrame:
    """Q17: rows, distinct real codes, placeholders and invalid codes."""
    real, held = F.col("code").rlike("^[0-9]{8}$"), F.col("code").startswith("PLACEHOLDER_")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.when(real, F.col("code"))).alias("n_real"), F.count_if(held).alias("n_placeholder"), F.count_if(~real & ~held).alias("n_invalid")
    )


def list_catalog(plan: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Q18: programs with their editions, and the tracks of each; the default is the active(program, edition) one, else the first."""
    tracks = plan.groupBy("program", "edition").agg(F.array_join(F.array_sort(F.collect_set(F.col("track").cast("string"))), ",").alias("tracks"))
    editions = F.transform(F.array_sort(F.collect_list(F.struct("edition", "tracks"))), lambda x: F.concat(x["edition"].cast("string"), F.lit(":"), x["tracks"]))
    listed = tracks.groupBy("program").agg(F.array_join(editions, ";").alias("editions"), F.min("edition").alias("__first"))
    chosen = listed.withColumn("default_edition", F.col("__first")) if active is None else listed.join(active.groupBy("program").agg(F.min("edition").alias("__active")), "program", "left").withColumn("default_edition", F.coalesce("__active", "__first"))
    return chosen.select("program", "editions", "default_edition")


def compare_counts(plan: DataFrame, over: str, first, second, by: list[str]) -> DataFrame:
    """By program: real codes on both sides and on one only, and for each side its rows, placeholders and codes that are neither."""
    sides = compare(plan, over, first, second, by).groupBy(*by).agg(*(F.count_if(F.col("side") == x).alias(f"n_{x}") for x in ("common", "first_only", "second_only")))
    tally = code_tally(plan.filter(F.col(over).isin(first, second)), [*by, over])
    each = [tally.filter(F.col(over) == v).select(*by, *(F.col(f"n_{c}").alias(f"{s}_{c}") for c in ("rows", "placeholder", "invalid"))) for s, v in (("first", first), ("second", second))]
    joined = sides.join(each[0], by, "full").join(each[1], by, "full")
    return joined.na.fill(0, [c for c in joined.columns if c not in by])


def compare(plan: DataFrame, over: str, first, second, by: list[str], where: Column | None = None) -> DataFrame:
    """Real codes of two editions or tracks: common, first_only or second_only. ValueError for one compared with itself."""
    if first == second:
        raise ValueError(f"the same {over} twice")
    codes = real_courses(plan if where is None else plan.filter(where)).filter(F.col(over).isin(first, second)).groupBy(*by, "code")
    sides = codes.agg(F.bool_or(F.col(over) == first).alias("a"), F.bool_or(F.col(over) == second).alias("b"))
    side = F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "first_only").otherwise("second_only")
    return sides.select(*by, "code", side.alias("side"))


def resolve_edition(asked: DataFrame, editions: DataFrame) -> DataFrame:
    """(program, year_label) -> edition and status: found, missing or ambiguous."""
    by = editions.groupBy("program", "year_label").agg(F.count_distinct("edition").alias("n"), F.min("edition").alias("edition"))
    joined = asked.join(by, ["program", "year_label"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return joined.select("program", "year_label", F.when(F.col("n") == 1, F.col("edition")).alias("edition"), status.alias("status"))
