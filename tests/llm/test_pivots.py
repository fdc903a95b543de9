import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantables.llm import pivots


def asks():
    return F.col("vec_id") % 20 == 0


def plain(rows, nearest=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = (x * np.array(v, np.float64)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:nearest]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def clustered(spark, n):
    r = np.random.default_rng(1)
    center = r.normal(size=(max(20, n // 50), 64))
    v = center[r.integers(0, len(center), n)] + 0.5 * r.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


def recall(df):
    rows = [(r.vec_id, list(r.embedding)) for r in df.select("vec_id", "embedding").collect()]
    want, got, at = plain(rows), {}, dict(rows)
    for r in pivots.search(df, asks()).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    assert all(sorted(x) == list(range(1, 21)) for x in got.values())
    for q, x in got.items():
        for v, s in x.values():
            assert math.isclose(s, float((np.array(at[q]) * np.array(at[v])).sum()), rel_tol=1e-12, abs_tol=1e-12)
        assert [v for v, _ in sorted(x.values(), key=lambda y: (-y[1], y[0]))] == [x[k][0] for k in sorted(x)]
    return np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q].values()}) / 20 for q in want])


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_without_structure(spark, sf):
    assert recall(spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")) >= 0.9


def test_work_shrinks_where_vectors_have_structure(spark):
    parts = []
    for n in (1000, 6000):
        df = clustered(spark, n)
        assert recall(df) >= 0.9
        parts.append(pivots.work(df, asks())[0])
    assert all(0 < x["scored"] <= x["met"] < 0.3 for x in parts)
    assert parts[1]["met"] < parts[0]["met"]


def test_footrule_is_the_sum_of_place_differences():
    r = np.random.default_rng(2)
    a, b = (np.array([r.permutation(12)[:5] for _ in range(20)]).astype(np.int16) for _ in range(2))
    got = pivots.footrule(a, pivots.places(b, 12))
    for i in range(20):
        for j in range(20):
            one, other = ({p: k for k, p in enumerate(x.tolist())} for x in (a[i], b[j]))
            assert got[i, j] == sum(abs(one.get(p, 5) - other.get(p, 5)) for p in range(12))


def test_large_files_fill_parts_of_their_own():
    first, parts = pivots._packed({0: 10, 1: 3 * pivots.BLOCK + 1, 3: 5, 4: pivots.BLOCK}, 6)
    assert parts.tolist() == [1, 4, 1, 1, 1, 1]
    held = {}
    for c in (0, 1, 3, 4):
        for p in range(first[c], first[c] + parts[c]):
            held.setdefault(p, []).append(c)
    assert all(len(x) == 1 or set(x) <= {0, 3} for x in held.values())


def test_equal_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, [-1.0, 2.0]), (101, [0.0, 1.0]), (120, None), (140, [0.0, 0.0]), (160, [nan, 1.0]), (180, [1.0, inf]), (200, [None, 1.0]), (220, []), (0, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in pivots.search(df, asks()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 100}
    assert got[20] == [*range(20)]
    assert got[0] == [*range(1, 21)]
    assert got[100] == [101, *range(19)]
    assert pivots.search(df.limit(0), asks()).count() == 0
    assert pivots.search(df, F.lit(False)).count() == 0
    for kind, x in (("float", 2.0), ("double", 0.1)):
        one = spark.createDataFrame([(0, [1.0]), (1, [x])], f"vec_id long, embedding array<{kind}>")
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in pivots.search(one, asks()).collect()] == [(0, 1, 1, x)]


def test_each_vector_size_is_searched_by_itself(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0]), (20, [1.0]), (40, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in pivots.search(df, asks()).collect()) == [(0, 1, 2.0), (20, 2, 3.0)]
