"""Temperature mixing of sources, realised as block permutations under a token budget.

A source's weight is its token share to the power of an exponent between 0
(even) and 1 (natural), scaled to sum 1. The exponent is bisected: the least
at which no source is repeated more often than a limit, or the one whose
weights have a target entropy, as far as the limit allows. The token budget
is the caller's, or the least at which every document comes once or more. Each source is then
read in epochs, each a permutation of its documents by hash; the last is cut
at the budget. A block takes from each source its weight's part of the
block's tokens, and is shuffled by hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantables.llm.common import cut, fresh

REPEAT_LIMIT = 4.0
BLOCK_TOKENS = 1 << 22
#: Rows of a source that are summed in order together, about.
RUN_ROWS = 4096
#: Halvings of the exponent's range; exponents whose entropy one pass over the sources finds.
STEPS, AT_ONCE = 60, 31


@dataclass(frozen=True)
class Mix:
    """scale: sum of all sources' token shares to the exponent's power; a weight is such a power divided by it."""

    exponent: float
    scale: float
    tokens: int
    budget: float


def mix(tokens: int, least: int, most: int, powers: Callable[[list[float]], list[tuple[float, float]]], repeat_limit: float = REPEAT_LIMIT, target_entropy: float | None = None, budget: int | None = None) -> Mix:
    """The exponent and budget of sources with so many tokens in all, in the smallest and in the largest.

    powers gives, for some exponents, the sums over all sources of share**x
    and of share**x * log(share): the sources themselves, of which there may
    be many, aren't needed. At the least budget that takes all documents the
    largest source comes once, and the smallest (most / least)**(1 - x) times,
    the most of any. Under a caller's budget that is smaller, so are repeats.
    ValueError for a limit below 1 or a budget below 1.
    """
    if repeat_limit < 1 or budget is not None and budget < 1:
        raise ValueError("repeat_limit and budget must be 1 or more")
    if not tokens:
        return Mix(1.0, 1.0, 0, 0.0)
    spread, largest = math.log(most / least), most / tokens

    def too_often(x: float) -> bool:
        if budget is None:
            return (1 - x) * spread > math.log(repeat_limit)
        # repeats of the smallest source: budget * its weight / its tokens
        return math.log(budget / tokens) + (x - 1) * math.log(least / tokens) - math.log(powers([x])[0][0]) > math.log(repeat_limit)

    low = high = 0.0
    if too_often(low):
        high = 1.0
        for _ in range(STEPS):
            half = (low + high) / 2
            low, high = (half, high) if too_often(half) else (low, half)
    if target_entropy is not None:
        low, top = high, 1.0

        def entropy(x: float, sums: tuple[float, float]) -> float:
            return math.log(sums[0]) - x * sums[1] / sums[0]

        if entropy(high, powers([high])[0]) > target_entropy:
            high = top
            while high - low > 2.0**-STEPS and (high + low) / 2 not in (low, high):
                grid = [low + (high - low) * k / (AT_ONCE + 1) for k in range(1, AT_ONCE + 1)]
                flat = [x for x, sums in zip(grid, powers(grid), strict=True) if entropy(x, sums) > target_entropy]
                low, high = max(flat, default=low), min((x for x in grid if x not in flat), default=high)
    scale = powers([high])[0][0]
    return Mix(high, scale, tokens, float(budget) if budget is not None else scale * tokens * largest ** (1 - high))


def powers_of(sources: DataFrame, tokens: int) -> Callable[[list[float]], list[tuple[float, float]]]:
    """mix()'s powers, from a table of sources (source, tokens): one pass for all exponents given."""
    share = F.col("tokens") / F.lit(tokens)

    def powers(exponents: list[float]) -> list[tuple[float, float]]:
        sums = [f(x) for x in exponents for f in (lambda x: F.sum(F.pow(share, F.lit(x))), lambda x: F.sum(F.pow(share, F.lit(x)) * F.log(share)))]
        row = sources.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()
        return list(zip(row[::2], row[1::2], strict=True))

    return powers


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, which, source, n_tokens): white-space words and an end token, so 1 or more; null source is ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("which"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), (words + 1).cast("long").alias("n_tokens"))


def place(docs: DataFrame, repeat_limit: float = REPEAT_LIMIT, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, budget: int | None = None) -> DataFrame:
    """documents(doc_id, text, source) -> a row for each time a document comes:
    doc_id, which, source, rows, n_tokens, epoch, weight, exponent, block, place.

    Every row comes at least once, unless the caller's token budget is too
    small for that: then each source is cut at its part of it. Rows that
    repeat (id, text and source) come together: `rows` of them, with the
    tokens of all. Only sums over all sources come to the driver. Running sums
    go by short runs of the permutation, after sums of the runs before, so a
    large source is many tasks' work. An empty table gives none. Other columns
    aren't read, whatever their names.
    """
    rows = cut(sizes(docs).groupBy("doc_id", "which", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")), "tokens")
    held = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    total, least, most = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.min("tokens"), F.max("tokens")).first()
    found = mix(total, least, most, powers_of(held, total), repeat_limit, target_entropy, budget)
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(found.exponent)) / F.lit(found.scale)
    sources = held.select("source", weight.alias("weight"), "tokens", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / RUN_ROWS))).cast("int").alias("run_bits"))
    sources = sources.withColumn("repeats", F.lit(found.budget) * F.col("weight") / F.col("tokens"))
    # a part of an epoch so short that rounding made it is none
    epochs = F.ceil(F.col("repeats") - 1e-9).cast("int")
    lot = F.xxhash64("source", "doc_id", "which", "epoch")
    run = F.when(F.col("run_bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(lot, 64 - run_bits)"))
    times = rows.join(sources, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("lot", lot).withColumn("run", run)
    runs = times.groupBy("source", "epoch", "run").agg(F.sum("n_tokens").alias("n"))
    before = runs.select("source", "epoch", "run", (F.sum("n").over(Window.partitionBy("source").orderBy("epoch", "run")) - F.col("n")).alias("before"))
    # lots as unsigned numbers, as runs are cut from their first bits
    inside = Window.partitionBy("source", "epoch", "run").orderBy(F.col("lot") < 0, "lot", "doc_id", "which").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = times.join(before, ["source", "epoch", "run"]).withColumn("at", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    taken = summed.filter((F.col("epoch") == 0) & F.lit(budget is None) | (F.col("at") < F.col("repeats") * F.col("tokens")))
    block = F.floor(F.col("at") / (F.col("weight") * block_tokens)).cast("long")
    shuffled = Window.partitionBy("block").orderBy(F.xxhash64("block", "lot"), "source", "doc_id", "which", "epoch")
    placed = taken.withColumn("block", block).withColumn("place", F.row_number().over(shuffled) - 1)
    return placed.select("doc_id", "which", "source", "rows", "n_tokens", "epoch", "weight", F.lit(found.exponent).alias("exponent"), "block", "place")


def mixed(docs: DataFrame, repeat_limit: float = REPEAT_LIMIT, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, budget: int | None = None) -> DataFrame:
    """The documents, each row as often as the mix has it, in its order; all their columns.

    A block is in one partition, its rows in order of their places, so a
    written table holds the blocks as they are to be read.
    """
    placed = place(docs, repeat_limit, target_entropy, block_tokens, budget)
    own, text, source, block, place_of, *of = fresh(docs, "__own", "__text", "__from", "__block", "__place", "__id", "__which", "__source")
    times = placed.select(*(F.col(c).alias(x) for c, x in zip(("doc_id", "which", "source", "block", "place"), (*of, block, place_of), strict=True)))
    named = docs.withColumns({own: F.col("doc_id").cast("long"), text: F.xxhash64(F.col("text").cast("string")), source: F.coalesce(F.col("source").cast("string"), F.lit(""))})
    joined = named.join(times, F.col(own).eqNullSafe(F.col(of[0])) & (F.col(text) == F.col(of[1])) & (F.col(source) == F.col(of[2])))
    return joined.repartition(block).sortWithinPartitions(block, place_of).select(*(f"`{c}`" for c in docs.columns))
