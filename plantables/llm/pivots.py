"""Approximate nearest neighbours by a permutation index.

Every vector is seen as the order of its nearest pivots. Its row stands in the
inverted file of its nearest pivot; a query looks into the files of its own
nearest pivots, ranks what it meets there by footrule distance (how far the
pivots' places differ, summed), and scores the near part exactly. Nearness is
the inner product, in double precision.

Pivots grow with the square root of the vectors, so files stay small. How many
files a query opens, and up to which footrule distance it scores, is measured
on a bounded sample of the queries whose neighbours a scan of all vectors
finds: where vectors have structure, both are small and don't grow with the
table; where they have none, most files must be opened to reach the recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.llm.common import Cut, cut

#: Pivots are PIVOTS_OF_ROOT times the square root of the distinct vectors, up to a power of two, within these bounds
#: (a bounded sample by a hash of the id; every vector is indexed).
PIVOTS_OF_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 4, 16, 8192
#: Length of a vector's list of nearest pivots.
LISTED = 32
#: Queries of the sample on which files to open and the footrule limit are measured, and the parts of
#: their true neighbours that must stand in opened files, and of these within the limit.
MEASURED, IN_FILES, IN_LIMIT = 256, 0.97, 0.98
#: Vectors of files that are compared in one task, and queries compared with them at a time.
BLOCK, QUERIES = 4096, 1024
NEAREST = 20
#: A query opens files until they hold so many times the wanted number of vectors, whatever was measured.
LEAST_MET = 4
#: Candidates kept over the wanted number while scores are still those of a matrix product.
SLACK = 8
FAR = np.iinfo(np.int16).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, and every component there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, pivots): the pivots by nearness to each vector; ties by pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable").astype(np.int16)


def places(lists: np.ndarray, n_pivots: int) -> np.ndarray:
    """(n, listed) lists of pivots -> (n_pivots, n): each pivot's place in each list, the list's length where it lacks it."""
    out = np.full((n_pivots, len(lists)), lists.shape[1], np.int16)
    out[lists, np.arange(len(lists))[:, None]] = np.arange(lists.shape[1], dtype=np.int16)
    return out


def footrule(lists: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lists (n, listed) against places() of others -> (n, others): footrule distance of the lists.

    A pivot that a list lacks has the length as its place. The distance is the
    sum over the other list of (length - p), as if no pivot were shared, and
    over the first of |p - j| - (length - p), which is 2 max(p, j) - j - length.
    """
    size = lists.shape[1]
    total = np.zeros((len(lists), at.shape[1]), np.int16)
    for j in range(size):
        total += np.maximum(at[lists[:, j]], np.int16(j))
    return 2 * total - np.int16(size * (size - 1))


def _matrix(column) -> np.ndarray:
    """A list column, each list of the same length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


@dataclass(frozen=True)
class Plan:
    """How a search goes: pivots, listed pivots, files a query opens, footrule limit."""

    n_pivots: int
    listed: int
    files: int
    limit: int


def _indexed(classes: DataFrame, pivots, listed: int) -> DataFrame:
    """(id, vec) -> (id, cell, near, vec): the inverted file, and the list of nearest pivots."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = orders(_matrix(b.column(1)).astype(np.float64), pivots.value)[:, :listed]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near[:, 0].astype(np.int32)), _lists(near, pa.int16()), b.column(1)], ["id", "cell", "near", "vec"])

    return classes.mapInArrow(scan, f"id long, cell int, near array<short>, vec {dict(classes.dtypes)['vec']}")


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of a query, ties to the smaller id."""
    return np.lexsort((ids, -score))[:n]


def _measured(index: DataFrame, sample: np.ndarray, pivots, listed: int, nearest: int) -> tuple[int, int]:
    """Files to open and footrule limit by true neighbours of sample queries, from one scan of the index."""
    asked = index.sparkSession.sparkContext.broadcast(sample)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        order = orders(queries, pivots.value)
        at, rank = places(order[:, :listed], len(pivots.value)), places(order, len(pivots.value))
        found: list[list] = [[] for _ in queries]
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                vec, near = _matrix(part.column(3)).astype(np.float64), _matrix(part.column(2))
                score, away = queries @ vec.T, footrule(near, at)
                for q in range(len(queries)):
                    n = min(nearest + 1, len(vec))
                    for d in np.argpartition(-score[q], n - 1)[:n]:
                        if not np.array_equal(vec[d], queries[q]):
                            found[q].append((float(score[q, d]), int(rank[near[d, 0], q]), int(away[d, q])))
                    found[q] = sorted(found[q], reverse=True)[:nearest]
        rows = [(q, *x) for q, some in enumerate(found) for x in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["q", "score", "rank", "away"])

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    rows = index.mapInArrow(scan, "q int, score double, rank int, away int").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= nearest).select("rank", "away").collect()
    if not rows:
        return 1, FAR - 1
    rank, away = (np.array(x) for x in zip(*rows, strict=True))
    files = int(np.quantile(rank, IN_FILES, method="higher")) + 1
    return files, int(np.quantile(away[rank < files], IN_LIMIT, method="higher"))


def _packed(held: dict[int, int], n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Files to parts of about BLOCK vectors: each file's first part, and how many it fills; short files share one."""
    first, parts = np.zeros(n_pivots, np.int32), np.ones(n_pivots, np.int32)
    part, room = 0, BLOCK
    for cell in range(n_pivots):
        n = held.get(cell, 0)
        if n > room:
            part, room = part + (room < BLOCK), BLOCK
        first[cell] = part
        if n > BLOCK:
            parts[cell] = -(-n // BLOCK)
            part, room = part + int(parts[cell]), BLOCK
        else:
            room -= n
    return first, parts


def _asking(asked: DataFrame, pivots, held: dict[int, int], plan: Plan, nearest: int, layout) -> DataFrame:
    """Queries (id, vec) -> (part, id, near, cells, vec): a row for each part that holds files which the query opens."""
    first, parts = layout
    sizes = np.array([held.get(c, 0) for c in range(plan.n_pivots)], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = orders(_matrix(b.column(1)).astype(np.float64), pivots.value)
            met = np.cumsum(sizes[order], axis=1)
            row, to, cells = [], [], []
            for i, opened in enumerate(order):
                n = max(plan.files, int(np.searchsorted(met[i], LEAST_MET * (nearest + 1))) + 1)
                some = opened[:n][sizes[opened[:n]] > 0]
                by_part: dict[int, list[int]] = {}
                for c in some.tolist():
                    for p in range(first[c], first[c] + parts[c]):
                        by_part.setdefault(p, []).append(c)
                row += [i] * len(by_part)
                to += by_part.keys()
                cells += by_part.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), b.column(0).take(take), _lists(order[:, : plan.listed], pa.int16()).take(take), pa.array(cells, pa.list_(pa.int16())), b.column(1).take(take)],
                ["part", "id", "near", "cells", "vec"],
            )

    return asked.mapInArrow(scan, f"part int, id long, near array<short>, cells array<short>, vec {dict(asked.dtypes)['vec']}")


FOUND = "query_id long, part int, id long, score double, met long, scored long"


def _compare(plan: Plan, nearest: int):
    """Queries of a part with the vectors of its files: the best by exact score of those within the footrule limit."""

    def compare(q: pa.Table, d: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in FOUND.split(", ")]
        out: list[tuple] = []
        if len(q) and len(d):
            d = d.sort_by([("cell", "ascending"), ("id", "ascending")])
            part, ids, cell = q["part"][0].as_py(), d["id"].to_numpy(), d["cell"].to_numpy()
            near, dv, qv = _matrix(d["near"]), _matrix(d["vec"]).astype(np.float64), _matrix(q["vec"]).astype(np.float64)
            at = places(_matrix(q["near"]), plan.n_pivots)
            away = np.full((len(ids), len(qv)), FAR, np.int16)
            opens = q["cells"].combine_chunks()
            asker = np.repeat(np.arange(len(qv)), opens.value_lengths().to_numpy())
            wanted = opens.flatten().to_numpy()
            by = np.argsort(wanted, kind="stable")
            wanted, asker = wanted[by], asker[by]
            cells, begin = np.unique(wanted, return_index=True)
            for c, some in zip(cells.tolist(), np.split(asker, begin[1:]), strict=True):
                low, high = np.searchsorted(cell, [c, c + 1])
                if low < high:
                    away[low:high, some] = footrule(near[low:high], at[:, some])
            n = min(nearest + 1, len(ids))
            # at least as many as are wanted, so that no query goes without
            limit = np.maximum(np.partition(away, n - 1, axis=0)[n - 1], plan.limit)
            kept = (away <= limit) & (away < FAR)
            met, scored = (away < FAR).sum(axis=0), kept.sum(axis=0)
            dense = kept.mean() > 1 / 16
            if dense:
                product = np.where(kept, dv @ qv.T, -np.inf)
            for i, asks in enumerate(q["id"].to_pylist()):
                if dense:
                    wide = min(n + SLACK, len(ids))
                    some = np.argpartition(-product[:, i], wide - 1)[:wide]
                    some = some[kept[some, i]]
                else:
                    some = np.flatnonzero(kept[:, i])
                score = (dv[some] * qv[i]).sum(axis=1)
                best = _best(score, ids[some], n)
                out += [(asks, part, int(ids[some[x]]), float(score[x]), int(met[i]), int(scored[i])) for x in best]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names)

    return compare


def _found(classes: DataFrame, asked: DataFrame, nearest: int) -> tuple[DataFrame, Plan] | None:
    """Distinct vectors (id, vec) and queries (id, vec), all of one size -> FOUND rows, and the plan; None if there are no queries."""
    spark = classes.sparkSession
    sample = asked.orderBy(F.xxhash64("id"), "id").select("vec").limit(MEASURED).collect()
    if not sample:
        return None
    n = classes.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(PIVOTS_OF_ROOT * max(1, n) ** 0.5)))))
    chosen = np.array([r.vec for r in classes.orderBy(F.xxhash64("id"), "id").select("vec").limit(wanted).collect()], np.float64)
    pivots = spark.sparkContext.broadcast(chosen)
    listed = min(LISTED, len(chosen))
    index = Cut(_indexed(classes, pivots, listed), "index")
    held = {r.cell: r.n for r in index.df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = Plan(len(chosen), listed, *_measured(index.df, np.unique(np.array([r.vec for r in sample], np.float64), axis=0), pivots, listed, nearest))
    layout = _packed(held, plan.n_pivots)
    asking = Cut(_asking(asked, pivots, held, plan, nearest, layout), "asking")
    rounds = asking.df.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("rounds"))
    where = spark.createDataFrame([(c, int(layout[0][c]), int(layout[1][c])) for c in held], "cell int, first int, parts int")
    dealt = index.df.join(F.broadcast(where), "cell").withColumn("part", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    data = dealt.join(rounds, "part").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).select("part", "round", "id", "cell", "near", "vec")
    asks = asking.df.join(rounds, "part").withColumn("round", F.pmod(F.xxhash64("id"), F.col("rounds")).cast("int")).select("part", "round", "id", "near", "cells", "vec")
    return asks.groupBy("part", "round").cogroup(data.groupBy("part", "round")).applyInArrow(_compare(plan, nearest), FOUND), plan


def _prepared(vectors: DataFrame, queries: Column) -> DataFrame:
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vec"), queries.alias("asks")).filter(usable(F.col("vec")))


def _searches(good: DataFrame, classes: DataFrame, nearest: int) -> Iterator[tuple[int, DataFrame, Plan]]:
    """(size of vectors, FOUND rows, plan) for each size that has queries."""
    for r in good.filter("asks").groupBy(F.size("vec").alias("size")).count().orderBy("size").collect():
        of_size = F.size("vec") == r["size"]
        asked = good.filter("asks").filter(of_size).select(F.col("vec_id").alias("id"), "vec").distinct()
        if found := _found(classes.filter(of_size), asked, nearest):
            yield r["size"], *found


def search(vectors: DataFrame, queries: Column, nearest: int = NEAREST) -> DataFrame:
    """vectors(vec_id, embedding), and which rows are queries -> (query_id, rank, vec_id, score).

    Candidates are all rows but the query's own; ties go to the smaller
    vec_id. Vectors of each size are a space of their own: one search a size,
    of which there are few. Those that usable() rules out take no part.
    Equal vectors are searched once, and stand for their smallest ids, as many
    as any result can hold. Rows that repeat a vec_id and vector count once.
    Fewer candidates give fewer rows; an empty table, or one without queries,
    gives none. Other columns aren't read.
    """
    good = _prepared(vectors, queries)
    # of equal vectors the smallest ids: one more than a result, as the query's own goes
    first = Window.partitionBy("vec").orderBy("vec_id")
    members = Cut(good.select("vec", "vec_id").distinct().select("vec", "vec_id", F.row_number().over(first).alias("n")).filter(F.col("n") <= nearest + 1), "members")
    classes = Cut(members.df.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec"), "vectors")
    of = cut(members.df.join(classes.df, "vec").select("id", "vec_id"), "classes")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    for _, found, _ in _searches(good, classes.df, nearest):
        met = met.unionByName(found.select("query_id", "id", "score"))
    top = met.select("*", F.row_number().over(best).alias("n")).filter(F.col("n") <= nearest + 1).drop("n")
    return top.join(of, "id").filter("vec_id <> query_id").select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").filter(F.col("rank") <= nearest)


def work(vectors: DataFrame, queries: Column, nearest: int = NEAREST) -> list[dict]:
    """What search() does, by size of vectors: its plan, distinct vectors, queries, and of all pairs of these
    the shares that are compared by footrule and scored exactly."""
    good = _prepared(vectors, queries)
    classes = cut(good.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec"), "vectors")
    out = []
    for size, found, plan in _searches(good, classes, nearest):
        each = found.groupBy("query_id", "part").agg(F.max("met").alias("met"), F.max("scored").alias("scored")).groupBy("query_id").agg(F.sum("met").alias("met"), F.sum("scored").alias("scored"))
        r = each.agg(F.count("*").alias("queries"), F.avg("met").alias("met"), F.avg("scored").alias("scored")).first()
        n = classes.filter(F.size("vec") == size).count()
        out.append({"size": size, "vectors": n, "queries": r.queries, "pivots": plan.n_pivots, "files": plan.files, "limit": plan.limit, "met": (r.met or 0) / n, "scored": (r.scored or 0) / n})
    return out
