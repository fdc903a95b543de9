"""A log of what repairs changed, from the rows before and after, and its application.

Any repair is a step from rows to rows with one key. Its log has a row for
each changed field (kind changed: field, old, new), for each dropped row
(kind dropped), and for each row that is new (kind added, once without a
field and once for each field that isn't null). Values are text; lists and
structs are JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantables.sources.scratch import written

Step = Callable[[DataFrame], DataFrame]
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def _text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, _NESTED) else c.cast("string")


def _value(c: Column, kind: T.DataType) -> Column:
    return F.from_json(c, kind.simpleString()) if isinstance(kind, _NESTED) else c.cast(kind)


def repair_log(before: DataFrame, after: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """(key, kind, field, old, new, rule) from rows before and after a step; the key names one row on either side and may be null.

    Fields are those that both have. Rows meet in one join on the key, null
    safe, and only differing fields leave it.
    """
    kinds = {f.name: f.dataType for f in before.schema.fields}
    fields = [c for c in before.columns if c in after.columns and c not in key]
    side = lambda df, x: df.select(*(F.col(k).alias(f"{x}_{k}") for k in key), *(_text(F.col(c), kinds[c]).alias(f"{x}__{c}") for c in fields), F.lit(True).alias(f"{x}_here"))
    on = [F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}")) for k in key]
    both = side(before, "b").join(side(after, "a"), on, "full_outer")
    entry = lambda kind, field, old, new: F.struct(F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    none = F.lit(None)
    b, a = (lambda c: F.col(f"b__{c}")), (lambda c: F.col(f"a__{c}"))
    changed = [F.when(~b(c).eqNullSafe(a(c)), entry("changed", c, b(c), a(c))) for c in fields]
    added = [entry("added", None, none, none), *(F.when(a(c).isNotNull(), entry("added", c, none, a(c))) for c in fields)]
    told = F.when(F.col("a_here").isNull(), F.array(entry("dropped", None, none, none))).when(F.col("b_here").isNull(), F.array(*added)).otherwise(F.array(*changed) if changed else F.array().cast("array<struct<kind:string,field:string,old:string,new:string>>"))
    names = [F.when(F.col("a_here").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in key]
    return both.select(*names, F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).select(*key, "x.*", F.lit(rule).alias("rule"))


def apply_log(before: DataFrame, log: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows after a step, from those before and its log; columns are those of before."""
    kinds = {f.name: f.dataType for f in before.schema.fields}
    fields = [c for c in before.columns if c not in key]
    # a row for each key: as many entries as it has fields
    values = log.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "new")))).alias("__new"), F.max(F.col("kind") == "dropped").alias("__drop"), F.max(F.col("kind") == "added").alias("__add"))
    held = values.select(*(F.col(k).alias(f"__{k}") for k in key), "__new", "__drop", "__add")
    joined = before.withColumn("__old", F.lit(True)).join(held, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "full_outer").filter("__drop is null or not __drop").filter("__old or __add")
    fixed = [F.when(F.map_contains_key("__new", F.lit(c)), _value(F.col("__new")[c], kinds[c])).otherwise(F.col(c)).alias(c) for c in fields]
    names = [F.when(F.col("__old"), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in key]
    chosen = {c: x for c, x in zip([*key, *fields], [*names, *fixed], strict=True)}
    return joined.select(*(chosen[c] for c in before.columns))


def with_log(rows: DataFrame, steps: Sequence[tuple[str, Step]], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Steps in order, each written once -> the repaired rows, and the log of all steps (step is its number)."""
    now, log = written(rows, "rows"), None
    for n, (rule, step) in enumerate(steps, 1):
        after = written(step(now), "rows")
        told = repair_log(now, after, key, rule).withColumn("step", F.lit(n))
        log = told if log is None else log.unionByName(told)
        now = after
    return now, log
