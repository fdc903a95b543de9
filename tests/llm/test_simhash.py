import numpy as np
import xxhash
from pyspark.sql import functions as F

from plantables.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def plain_components(rows):
    """rows (doc_id, fp) -> {doc_id: smallest reachable}, by comparing all."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, f) in enumerate(rows):
        for e, g in rows[:i]:
            if ((f ^ g) & (2**64 - 1)).bit_count() <= 2:
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d, _ in rows}


def test_fingerprints_of_odd_texts():
    for text in (None, "", " \t\n", "one", "One two", "a b c", "a b c d", "ä ß Ü ñ x", "a\x0bb\x1cc d e", "x " * 5000):
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for flips in (0, 1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        assert all(set(a) & set(b) for a, b in zip(simhash.golay_keys(words), simhash.golay_keys(other), strict=True))


def test_links_match_brute_force_for_small_and_full_buckets(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    fps = set(base)
    for f in base[:20]:
        for _ in range(6):
            g = f & (2**64 - 1)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                g ^= 1 << int(b)
            fps.add(g - (1 << 64) if g >> 63 else g)
    for i in range(40):  # a crowd around one fingerprint
        g = (base[0] & (2**64 - 1)) ^ 1 << i
        fps.add(g - (1 << 64) if g >> 63 else g)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    want = plain_components(rows)
    for full in (2, 16, 10_000):
        edges = simhash.links(spark.createDataFrame([(f,) for _, f in rows], "fp long"), full)
        label = {r.node: r.label for r in simhash.components(edges).collect()}
        number = {f: i for i, f in rows}
        assert {i: number[label.get(f, f)] for i, f in rows} == want


def test_near_duplicates_and_keep_one(spark):
    texts = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, None), (8, ""), (7, "quite another text than that one"), (7, "quite another text than that one"), (None, "no id here at all")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (7, 7), (None, None)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 7, 8]
    assert kept.count() == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_unlike_texts_under_one_id_stay(spark):
    rows = [(1, "one text of its own here"), (1, "quite another matter than that"), (1, "one text of its own here"), (2, "One text of its own here"), (3, "quite another matter than that")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("which", F.lit("clash")).withColumn("head", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text.lower()) for r in kept.collect()) == sorted(rows[:2])
