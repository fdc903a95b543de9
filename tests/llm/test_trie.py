import hashlib
import random
import zlib

import pytest

from plantables.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in given.items()}
    made = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = given.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        leaves = [s for s in below if not any(len(x) == len(s) + 1 and x[:-1] == s for x in nodes)]
        children = [s for s in below if len(s) == len(seq) + 1]
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(seq))))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r)[1:] for r in df.collect()), key=repr)


def talks(seed, n, long=0):
    r = random.Random(seed)
    rows = []
    for c in r.sample([*range(-150, 350), 1000, 1001], n):
        rows += [(c, i, r.choice(["user", "assistant", None]), r.choice(["a", "bc", "", None, "def ghi"])) for i in range(r.choice([0, 1, 2, 4, 7, 12]))]
    rows += [(7000 + i % 2, i // 2, "user", str(i // 2 % 5)) for i in range(long)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [trie.FEW, 20])
def test_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(trie, "FEW", few)
    monkeypatch.setattr(trie, "RANGE", 64)
    monkeypatch.setattr(trie, "GROUPS", 3)
    rows = talks(few, 120, 60)
    rows += [(None, 1, "user", "x"), (5, None, "user", "n"), (100, None, None, None), (100, 1, "user", "x"), (100, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{SCHEMA}, depth int, K1 string").repartition(3)
    assert rows_of(trie.trie(df)) == brute(rows)


def test_conversations_over_several_parts(spark):
    rows = talks(3, 10, 900) + [(7002, i, "user", str(i % 5)) for i in range(450)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.numbered(trie.hashed(spark.createDataFrame(rows, SCHEMA))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {(r.conv_id, r["at"]): tuple(r)[3:6] for r in found}
    assert len(by) == len(found) == len(rows)
    for i in range(1, 451):
        assert by[7000, i] == by[7001, i] == by[7002, i]
    assert len({by[7000, i] for i in range(1, 451)}) == 450
    for r in found:
        assert tuple(r)[6:] == by.get((r.conv_id, r["at"] - 1), (0, 0, 0))


def test_ranks_of_any_list(spark, monkeypatch):
    monkeypatch.setattr(trie, "FEW", 7)
    order = list(range(500))
    random.Random(1).shuffle(order)
    arcs = spark.createDataFrame(list(zip(order, order[1:])), "arc long, next long")
    assert {r.arc: r.pos for r in trie.ranked(arcs).collect()} == {a: i for i, a in enumerate(order)}


def test_no_rows_and_no_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.trie(none).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    lone = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "gone")]  # its first turns come from a conversation that isn't there
    assert rows_of(trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and len(brute(rows)) == 1
