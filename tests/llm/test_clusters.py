import hashlib
import math

import numpy as np
import pytest

from plantables.llm import clusters


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in named[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(assign(v)[1], []).append(v)
        centers = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c for j, c in enumerate(centers)]
    found = [(i, *assign(v)[::-1]) for i, v in kept] if centers else []
    each = {}
    for _, j, d in found:
        each[j] = each.get(j, 0) + d
    return sorted(((i, j, d, each[j], sum(each.values()), tuple(centers[j])) for i, j, d in found), key=repr)


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect()), key=repr)


def vectors(n, size, seed):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(5, size))
    return [(i, [float(x) for x in (centers[i % 5] + random.normal(scale=0.2, size=size)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("entries", [clusters.ENTRIES, 3])
@pytest.mark.parametrize("size", [6, 5, 1])
def test_as_brute_force(spark, monkeypatch, entries, size):
    monkeypatch.setattr(clusters, "ENTRIES", entries)
    monkeypatch.setattr(clusters, "SLAB", 50)
    rows = vectors(200, size, size)
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (900, None), (901, []), (902, [0.0] * (size + 1)), (903, [None] * size), (904, [math.nan] * size), (905, [math.inf] * size), (906, [0.0] * size), (907, [-1e4] * size)]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<float>, distance double, cluster string").repartition(3)
    assert rows_of(clusters.cluster(df, 7, 3, size)) == brute(rows, 7, 3, size)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, -1.0]), (None, [3.0, 3.0])], "vec_id long, embedding array<float>")
    assert rows_of(clusters.cluster(df, 16, 3, 2)) == brute([(1, [0.5, 1.0]), (2, [0.25, -1.0]), (None, [3.0, 3.0])], 16, 3, 2)
    for none in (df.limit(0), df.filter("vec_id is null")):
        assert clusters.cluster(none, 16, 3, 2).count() == 0


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    same = [(i, [1.0, 2.0]) for i in range(20)]
    df = spark.createDataFrame(same, "vec_id long, embedding array<double>")
    found = rows_of(clusters.cluster(df, 4, 3, 2))
    assert found == brute(same, 4, 3, 2) and {r[1] for r in found} == {0}


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = clusters.cluster(df, 2, 1, 2).collect()
    assert {r.distance for r in rows} == {0} and (clusters.LARGEST - 1, -clusters.LARGEST) in {tuple(r.centroid) for r in rows}
