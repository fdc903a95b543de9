"""The prerequisite graph: neighbours, closures that end on cycles, and clean edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantables.operators.views import SCOPE
from plantables.sources.scratch import written


def neighbours(edges: DataFrame, codes: list[str], kind: str, back: bool = False) -> DataFrame:
    """G1: what the codes require or, read back, unlock; distinct."""
    here, there = ("requires", "code") if back else ("code", "requires")
    return edges.filter(F.col(here).isin(codes) & (F.col("kind") == kind)).select(F.col(here).alias("code"), F.col(there).alias("other")).distinct()


#: Steps that a round of a closure takes at most, and rows of them for each edge.
MOST_STEPS, STEP_ROWS = 8, 8


def _far_steps(step: DataFrame, asked: int) -> tuple[DataFrame, int]:
    """Edges (at, next) -> (at, next, far): all that is reached in up to k steps, at the least far; and k, a power of two.

    k is doubled while there are no more such rows than STEP_ROWS for each
    edge, or for each row asked, so that few seeds, or dense graphs, go edge by edge.
    """
    steps, k = written(step.withColumn("far", F.lit(1)), "steps"), 1
    most = STEP_ROWS * min(steps.count(), asked)
    while k < MOST_STEPS:
        more = steps.select("at", F.col("next").alias("__over"), F.col("far").alias("__far")).filter(F.col("__far") == k).join(steps.withColumnRenamed("at", "__over"), "__over")
        far = written(steps.unionByName(more.select("at", "next", (F.col("far") + k).alias("far"))).groupBy("at", "next").agg(F.min("far").alias("far")), "steps")
        if far.count() > most:
            break
        steps, k = far, 2 * k
    return steps, k


def closure(edges: DataFrame, seeds: DataFrame, kind: str = "pre", back: bool = False) -> DataFrame:
    """(seed, code) for all that is reached over edges of a kind, the seed only over a cycle.

    Semi-naive: a round joins what the last one found with all that is reached
    in up to k steps, and drops what was found before, so cycles end. Only what
    was found k steps away goes on, as what follows the rest is found with it.
    A round's result is written to the folder that executors share; the driver
    only sees counts.
    """
    step = edges.filter(F.col("kind") == kind)
    step = step.select(F.col("requires").alias("at"), F.col("code").alias("next")) if back else step.select(F.col("code").alias("at"), F.col("requires").alias("next"))
    start = seeds.select(F.col("code").alias("seed"), F.col("code").alias("at")).distinct()
    steps, k = _far_steps(step.distinct(), start.count())
    reach = lambda front: front.join(steps, "at").groupBy("seed", F.col("next").alias("code")).agg(F.min("far").alias("far"))
    front = written(reach(start), "closure")
    seen = front.select("seed", "code")
    while not (ends := front.filter(F.col("far") == k)).isEmpty():
        more = reach(ends.select("seed", F.col("code").alias("at")))
        front = written(more.join(seen, ["seed", "code"], "left_anti"), "closure")
        seen = seen.unionByName(front.select("seed", "code"))
    return seen


def earlier_year(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """Courses of a scope that require one of an earlier year, for each pair of years in which they stand."""
    years = plan.select(*SCOPE, "code", "year").distinct()
    needs = years.withColumnsRenamed({"code": "requires", "year": "requires_year"})
    return years.join(edges.select("code", "requires").distinct(), "code").join(needs, [*SCOPE, "requires"]).filter("requires_year < year").select(*SCOPE, "code", "year", "requires", "requires_year")


def degrees(edges: DataFrame) -> DataFrame:
    """By kind: edges, and the distinct courses at both ends."""
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"), F.count_distinct("code").alias("n_codes"), F.count_distinct("requires").alias("n_required"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """No edge to itself or to a placeholder, each once."""
    held = F.col("code").startswith("PLACEHOLDER_") | F.col("requires").startswith("PLACEHOLDER_")
    return edges.filter((F.col("code") != F.col("requires")) & ~held).select("code", "requires", "kind").distinct()
