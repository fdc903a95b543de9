import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plantables.llm import sharding


def check(rows, shards):
    n = Counter(r.shard for r in rows)
    assert set(n) <= set(range(shards))
    counts = [n[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return n


def test_counts_slots_and_groups(spark):
    rows = [(i, f"own text {i}") for i in range(600)] + [(1000 + i, f"group {i % 40}") for i in range(200)] + [(3000 + i, "hot") for i in range(400)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, shard int")
    got = sharding.assign(docs, 8).collect()
    check(got, 8)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    by = dict(rows)
    groups = defaultdict(set)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(by[r.doc_id]) + 1, zlib.crc32(by[r.doc_id].encode()), "rows", None)
        if by[r.doc_id].startswith("group"):
            groups[by[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in groups.values())  # all fit


def fewest_cuts(sizes, room):
    """By trying all placements: 0 if some placement keeps all groups whole, else None."""
    if not sizes:
        return 0
    for s in sorted(set(room), reverse=True):
        if s >= sizes[0]:
            rest = list(room)
            rest[rest.index(s)] -= sizes[0]
            if fewest_cuts(sizes[1:], rest) == 0:
                return 0
    return None


def spans_of(spark, sizes, single, shards):
    """Shards that a group is in beyond one, for each group of equal text that is cut."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"single {i}" for i in range(single)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.assign(docs, shards).collect()
    check(rows, shards)
    groups = defaultdict(set)
    for r in rows:
        groups[texts[r.doc_id]].add(r.shard)
    return [len(x) - 1 for x in groups.values() if len(x) > 1]


@pytest.mark.parametrize("sizes", [[60], [90, 50, 50, 30, 30, 30, 20], [90, 90, 90, 80, 70, 60, 50], [55, 55, 45, 45, 35, 35, 65, 65, 30, 30, 25, 25]], ids=len)
def test_no_group_is_cut_that_fits(spark, sizes):
    assert fewest_cuts(sorted(sizes, reverse=True), [100] * 8) == 0
    assert spans_of(spark, sizes, 800 - sum(sizes), 8) == []


def test_a_group_larger_than_a_shard_is_cut_as_seldom_as_can_be(spark):
    assert spans_of(spark, [150, 90, 50, 30], 480, 8) == [1]
    assert spans_of(spark, [700], 100, 8) in ([6], [7])


def test_groups_that_cannot_all_stay_whole(spark):
    """Five groups of 0.6 shards in four: one fits nowhere; it and the one that it is placed beside may be cut, the others not."""
    assert fewest_cuts([60] * 5, [100] * 4) is None
    assert 1 <= len(spans_of(spark, [60] * 5, 100, 4)) <= 2


def test_best_fit_leaves_least_room():
    assert sharding.best_fit({1: 5, 2: 4, 3: 3, 4: 6}, 20, 2) == {4: 0, 1: 1, 2: 0, 3: 1}
    assert sharding.best_fit({}, 0, 4) == {}


def test_equal_texts_stay_together(spark):
    """All groups of the given documents fit whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.assign(docs).collect()
    check(got, 16)
    groups = defaultdict(set)
    for r in got:
        groups[(r.text_crc32, r.size)].add(r.shard)
    assert max(len(x) for x in groups.values()) == 1


def test_all_columns_with_each_rows_own_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED_ROWS", 7)
    long = "w " * 300_000
    rows = [(1, "x", "a", 5), (1, "x", "b", 5), (1, "x", "b", 5), (None, None, "c", 6), (2, "", None, 7), (3, long, "d", 8)] + [(10 + i, "hot", "e", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").withColumn("row", F.lit(1)).withColumn("node", F.lit("n"))
    out = sharding.sharded(docs, 4)
    assert out.columns == ["doc_id", "text", "source", "row", "node", "law", "shard", "slot"]
    got = out.collect()
    check(got, 4)
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(x[:3] for x in rows)
    assert sharding.sharded(docs.limit(0), 4).count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (1, "é"), (None, "x"), (None, None), (2, "")], "doc_id long, text string")
    got = sharding.assign(docs, 4).collect()
    check(got, 4)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted([(1, 1, 0), (1, 1, 0), (1, 3, zlib.crc32("é".encode())), (0, 2, zlib.crc32(b"x")), (0, 1, 0), (2, 1, 0)])
    assert sharding.assign(docs.limit(0), 4).count() == 0
