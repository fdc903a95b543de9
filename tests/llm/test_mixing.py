import math
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from plantables.llm import mixing


def hash64(*values):
    """Spark's xxhash64 of strings, longs and ints (given as (n,)); nulls leave the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def plain_mix(tokens, limit, target=None, budget=None):
    """Exponent, weights and budget by trying exponents on all sources."""
    total = sum(tokens.values())

    def of(x):
        raw = {s: (n / total) ** x for s, n in tokens.items()}
        w = {s: v / math.fsum(raw.values()) for s, v in raw.items()}
        b = budget or max(n / w[s] for s, n in tokens.items())
        return w, b, max(b * w[s] / n for s, n in tokens.items()), -math.fsum(v * math.log(v) for v in w.values())

    low, high = 0.0, 1.0
    for _ in range(60):
        half = (low + high) / 2
        _, _, most, flat = of(half)
        low, high = (half, high) if most > limit + 1e-12 or target is not None and flat > target else (low, half)
    return (high, *of(high)[:2])


def plain_place(rows, limit, run_rows, block_tokens, weights, exponent, repeats):
    """rows (doc_id, text, source) -> {(doc_id, which, source, epoch): (n_tokens, block, place)}, one source after the other."""
    held = defaultdict(lambda: [0, 0])
    for d, t, s in rows:
        cell = held[(s or "", d, hash64(t))]
        cell[0] += len((t or "").split()) + 1
        cell[1] += 1
    out, total = {}, Counter()
    for (s, _, _), (n, _) in held.items():
        total[s] += n
    for s in total:
        at = 0
        for epoch in range(math.ceil(repeats[s] - 1e-9)):
            order = sorted((hash64(s, d, w, (epoch,)) & (2**64 - 1), d, w) for z, d, w in held if z == s)
            for lot, d, w in order:
                n = held[(s, d, w)][0]
                if epoch == 0 or at < repeats[s] * total[s]:
                    out[(d, w, s, epoch)] = [n, math.floor(at / (weights[s] * block_tokens)), lot]
                at += n
    blocks = defaultdict(list)
    for key, (_, block, lot) in out.items():
        signed = lot - (1 << 64) if lot >> 63 else lot
        blocks[block].append((hash64(block, signed), key))
    return {key: (out[key][0], block, place) for block, some in blocks.items() for place, (_, key) in enumerate(sorted(some, key=lambda x: (x[0], x[1][2], x[1][0], x[1][1], x[1][3])))}


def found(spark, tokens, **options):
    sources = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    total = sum(tokens.values())
    m = mixing.mix(total, min(tokens.values()), max(tokens.values()), mixing.powers_of(sources, total), **options)
    weights = {s: (n / total) ** m.exponent / m.scale for s, n in tokens.items()}
    return m, weights, {s: m.budget * w / tokens[s] for s, w in weights.items()}


def entropy(weights):
    return -math.fsum(w * math.log(w) for w in weights.values())


@pytest.mark.parametrize("options", [{}, {"repeat_limit": 1.0}, {"repeat_limit": 1e9}, {"target_entropy": 0.8, "repeat_limit": 1000.0}, {"target_entropy": 0.05, "repeat_limit": 50.0}, {"budget": 3000}, {"budget": 300, "repeat_limit": 2.0}])
def test_exponent_meets_its_targets(spark, options):
    tokens = {"a": 1000, "b": 100, "c": 10}
    m, weights, repeats = found(spark, tokens, **options)
    exponent, want, budget = plain_mix(tokens, options.get("repeat_limit", mixing.REPEAT_LIMIT), options.get("target_entropy"), options.get("budget"))
    assert m.exponent == pytest.approx(exponent, abs=1e-9) and m.budget == pytest.approx(budget) and weights == pytest.approx(want)
    assert math.fsum(weights.values()) == pytest.approx(1.0)
    if options == {"target_entropy": 0.8, "repeat_limit": 1000.0}:
        assert entropy(weights) == pytest.approx(0.8, abs=1e-9)
    if not options:
        assert max(repeats.values()) == pytest.approx(4.0) and min(repeats.values()) == pytest.approx(1.0)


def test_no_sources_and_wrong_limits():
    assert mixing.mix(0, None, None, None).budget == 0.0
    for wrong in ({"repeat_limit": 0.5}, {"budget": 0}):
        with pytest.raises(ValueError):
            mixing.mix(10, 10, 10, None, **wrong)


def test_places_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 16)
    rows = [(i, "w " * (i % 9), "big") for i in range(900)] + [(1000 + i, "x y z", "mid") for i in range(100)] + [(2000 + i, "x", None) for i in range(20)]
    rows += [(5, "w " * 5, "big"), (None, "no id", "mid"), (None, "no id", "mid"), (7, None, "big"), (8, "w " * 40_000, "mid")]
    clash = {c: F.lit("x") for c in ("which", "rows", "weight", "block", "place", "epoch", "lot", "run", "tokens", "n_tokens")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(clash)
    got = mixing.place(docs, 4.0, block_tokens=500).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s or ""] += len((t or "").split()) + 1
    m, weights, repeats = found(spark, dict(tokens))
    assert {r.source: r.weight for r in got} == pytest.approx(weights) and {r.exponent for r in got} == {m.exponent}
    want = plain_place(rows, 4.0, 16, 500, {r.source: r.weight for r in got}, m.exponent, repeats)
    assert {(r.doc_id, r.which, r.source, r.epoch): (r.n_tokens, r.block, r.place) for r in got} == want
    times = Counter()
    for r in got:
        times[r.doc_id] += r.rows
    mixed = mixing.mixed(docs, 4.0, block_tokens=500)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == times


def test_mixed_rows_stand_in_the_order_of_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5), f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    order = [r.doc_id for r in mixing.place(docs, 1.0, block_tokens=1 << 30).orderBy("block", "place").collect()]
    assert [r.doc_id for r in mixing.mixed(docs, 1.0, block_tokens=1 << 30).collect()] == order


def test_budget_of_the_caller(spark):
    docs = spark.createDataFrame([(i, "x y", "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    for budget in (300, 2400):
        got = mixing.place(docs, 4.0, budget=budget).collect()
        assert sum(r.n_tokens for r in got) == pytest.approx(budget, abs=6)
        assert max(Counter(r.doc_id for r in got).values()) <= 4


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "a"), (2, "x", "")], "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert {(r.doc_id, r.text, r.source) for r in got} == {(1, None, None), (None, "", "a"), (2, "x", "")}
    assert Counter(r.doc_id for r in got)[1] % 2 == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
