"""Centroid clustering over dictionaries of subvectors: exact integer k-means of a fixed number of rounds.

A vector of integers is cut into blocks of two components. The distinct
subvectors of each block are its dictionary, found once over the whole table,
and a vector is kept as its codes, losslessly. In each round the squared
distance of each dictionary entry to each centroid is computed once; a
vector's distance is the sum of its codes' partial distances.

The dictionary grows with the range of the components, not with the rows. It
is counted before it is sent to the workers; where it has more than ENTRIES
entries, each batch of vectors makes the same dictionaries of its own rows,
so no table of any size leaves this path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantables.llm.common import Cut

#: Centroids, rounds, components of a vector, and factor of a component before it is floored.
CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Dictionary entries that may be broadcast (8 bytes for each centroid).
ENTRIES = 1 << 19
#: Integers are held to this size, so that sums of squares stay in 64 bits. It changes no component below a million.
LARGEST = 1 << 26
_BASE = LARGEST << 1
#: Vectors that are worked on at a time.
SLAB = 1 << 14

Dictionary = list[np.ndarray]


def packed(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and the kept ones' subvectors: one number for each block of two integers."""
    lists = vectors.cast(pa.list_(pa.float64())) if pa.types.is_list(vectors.type) else pa.nulls(len(vectors), pa.list_(pa.float64()))
    n = lists.value_lengths().fill_null(-1).to_numpy()
    right = np.flatnonzero(n == size)
    if not len(right):
        return right, np.empty((0, (size + 1) // 2), np.int64)
    flat = lists.take(pa.array(right)).flatten()
    m = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
    fine = np.isfinite(m).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(m[fine] * SCALE), -LARGEST, LARGEST - 1).astype(np.int64)
    if size % 2:
        whole = np.concatenate([whole, np.zeros((len(whole), 1), np.int64)], axis=1)
    return right[fine], whole[:, ::2] * _BASE + (whole[:, 1::2] + LARGEST)


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = keys // _BASE
    return first, keys - first * _BASE - LARGEST


def partial(dictionary: Dictionary, centroids: np.ndarray) -> list[np.ndarray]:
    """Squared distances of each block's entries (rows) to the same block of each centroid (columns)."""
    out = []
    for b, keys in enumerate(dictionary):
        x, y = unpacked(keys)
        out.append((x[:, None] - centroids[:, 2 * b]) ** 2 + (y[:, None] - centroids[:, 2 * b + 1]) ** 2)
    return out


def nearest(codes: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and its distance."""
    total = np.take(tables[0], codes[:, 0], axis=0)
    for b in range(1, len(tables)):
        total += np.take(tables[b], codes[:, b], axis=0)
    label = total.argmin(axis=1)
    return label, total[np.arange(len(total)), label]


def _own(keys: np.ndarray) -> tuple[Dictionary, np.ndarray]:
    """Dictionaries of these rows alone, and their codes."""
    pairs = [np.unique(keys[:, b], return_inverse=True) for b in range(keys.shape[1])]
    return [d for d, _ in pairs], np.stack([c for _, c in pairs], axis=1)


def _matrix(column: pa.Array, blocks: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, blocks)


def _list(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1)))


class Coded:
    """Kept vectors as codes: df(vec_id, codes), and the dictionary where it may be broadcast; else codes are the subvectors themselves."""

    def __init__(self, vectors: DataFrame, size: int):
        self.size, self.blocks = size, (size + 1) // 2
        blocks = self.blocks

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLAB):
                    b = batch.slice(at, SLAB)
                    rows, found = packed(b.column(1), size)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _list(found)], ["vec_id", "codes"])

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, _ = _own(_matrix(batch.column(0), blocks)) if batch.num_rows else ([], None)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(blocks, dtype=np.int32), [len(d) for d in own])), pa.array(np.concatenate(own))], ["block", "key"])

        spark = vectors.sparkSession
        kept = Cut(vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).mapInArrow(keys, "vec_id long, codes array<long>"), "subvectors")
        entries = Cut(kept.df.select("codes").mapInArrow(distinct, "block int, key long").distinct(), "dictionary")
        self.dictionary, self.df, self.table = None, kept.df, kept
        if 0 < entries.df.count() <= ENTRIES:
            listed = entries.df.toArrow().to_pydict()
            block, key = np.array(listed["block"], np.int32), np.array(listed["key"], np.int64)
            self.dictionary = [np.sort(key[block == b]) for b in range(blocks)]
            sent = spark.sparkContext.broadcast(self.dictionary)

            def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        m = _matrix(b.column(1), blocks)
                        coded = np.stack([np.searchsorted(d, m[:, i]) for i, d in enumerate(sent.value)], axis=1).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([b.column(0), _list(coded)], ["vec_id", "codes"])

            self.table = Cut(kept.df.mapInArrow(encode, "vec_id long, codes array<int>"), "codes")
            self.df = self.table.df
            kept.drop()
        entries.drop()

    def vectors(self, codes: list[int]) -> list[int]:
        """A row's integers, from its codes."""
        keys = np.array([d[c] for d, c in zip(self.dictionary, codes, strict=True)] if self.dictionary else codes, np.int64)
        return np.stack(unpacked(keys), axis=1).reshape(-1)[: self.size].tolist()

    def over(self, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
        """A task's batches -> (batch, label, distance, dictionary, codes), by partial distances computed once for the global dictionary."""
        blocks, shape = self.blocks, np.zeros((len(centroids), 2 * self.blocks), np.int64)
        shape[:, : self.size] = centroids
        known = self.dictionary is not None
        sent = self.df.sparkSession.sparkContext.broadcast((self.dictionary, partial(self.dictionary, shape)) if known else None)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLAB):
                    b = batch.slice(at, SLAB)
                    codes = _matrix(b.column(1), blocks)
                    if known:
                        dictionary, tables = sent.value
                    else:
                        dictionary, codes = _own(codes)
                        tables = partial(dictionary, shape)
                    yield b, *nearest(codes, tables), dictionary, codes

        return walk


def moved(coded: Coded, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the exact floor of its vectors' mean; empty ones stay."""
    walk, blocks, size, k = coded.over(centroids), coded.blocks, coded.size, len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, 2 * blocks), np.int64)
        for _, label, _, dictionary, codes in walk(batches):
            order = np.argsort(label, kind="stable")
            some, first = np.unique(label[order], return_index=True)
            n += np.bincount(label, minlength=k)
            for b, keys in enumerate(dictionary):
                for i, part in enumerate(unpacked(keys)):
                    total[some, 2 * b + i] += np.add.reduceat(part[codes[order, b]], first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), size)), pa.array(np.tile(np.arange(size, dtype=np.int32), k)), pa.array(np.repeat(n, size)), pa.array(total[:, :size].reshape(-1))], ["cluster", "at", "n", "total"]
        )

    out = centroids.copy()
    for r in coded.df.mapInArrow(sums, "cluster int, at int, n long, total long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if r.n:
            out[r.cluster, r.at] = r.total // r.n
    return out


def seeds(coded: Coded, clusters: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of "1:" and their id, as first centroids; rows without an id are none. Equal ids go by their codes."""
    hashed = coded.df.filter("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "codes")
    return np.array([coded.vectors(r.codes) for r in hashed.orderBy("h", "codes").limit(clusters).collect()], np.int64).reshape(-1, coded.size)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid), one row for each kept row.

    Vectors that are null, of another size, or hold a null or non-finite
    component take no part. Rows that repeat, or have no id, are vectors of
    their own; those without an id are never first centroids. Fewer rows with
    an id than clusters give as many clusters; none gives no rows. Other
    columns are ignored.
    """
    coded = Coded(vectors, size)
    centroids = seeds(coded, clusters)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(coded, centroids)
    walk = coded.over(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, label, distance, _, _ in walk(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = Cut(coded.df.mapInArrow(assign, schema), "clusters").df
    coded.table.drop()
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    every = [(i, inertia.get(i, 0), sum(inertia.values()), c.tolist()) for i, c in enumerate(centroids)]
    # a row for each centroid: as many as the parameter says
    return found.join(F.broadcast(vectors.sparkSession.createDataFrame(every, "cluster int, cluster_inertia long, inertia long, centroid array<long>")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
