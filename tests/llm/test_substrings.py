from collections import Counter

import numpy as np
import pytest

from plantables.llm import substrings as S


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(seed, docs=120, alphabet=400):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(alphabet)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 300)))) for _ in range(docs)]
    for _ in range(docs):
        a, b = rng.integers(0, docs, 2)
        x, y = texts[a].split(), texts[b].split()
        i, n, j = int(rng.integers(0, len(x) + 1)), int(rng.integers(20, 90)), int(rng.integers(0, len(y) + 1))
        texts[b] = " ".join(y[:j] + x[i : i + n] + y[j:])
    return texts


@pytest.mark.parametrize(("seed", "alphabet"), [(1, 400), (2, 3), (3, 1), (4, 40)])
def test_matches_brute_force(spark, monkeypatch, seed, alphabet):
    monkeypatch.setattr(S, "TOGETHER", 1000)
    texts = [*corpus(seed, alphabet=alphabet), None, "", " \t ", "a " * 200, "a " * 34, "b " * 35, "c " * 36, "x y " * 60, "x y z " * 40, "Ä ö " * 3]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(docs).collect()}
    assert got == dict(enumerate(plain(texts, 35)))


def test_repeated_ids_nulls_and_empty_table(spark):
    long = " ".join(f"u{i}" for i in range(50))
    rows = [(1, long), (1, long), (1, "other text"), (None, " ".join(f"v{i}" for i in range(40))), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == [(0, 40, 0), (1, 2, 0), (1, 50, 50), (1, 50, 50), (2, 0, 0)]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_symbols_depend_on_their_stretch_only():
    rng = np.random.default_rng(5)
    core = rng.integers(0, 50, 120).astype(np.uint64)
    found = []
    for left, right in ((0, 0), (30, 17), (5, 60)):
        words = np.concatenate([rng.integers(50, 90, left).astype(np.uint64), core, rng.integers(50, 90, right).astype(np.uint64)])
        n = len(words)
        inside = [{(int(x), int(a) - left, int(b) - left) for x, a, b in zip(*r, strict=True) if a >= left and b <= left + 120} for r in S.rounds(words, np.zeros(n, int), np.full(n, n))]
        found.append(inside)
    for one, other in ((1, 2), (2, 1)):
        for x, y in zip(found[one], found[other], strict=True):
            assert x == y
    assert all(len(x) > 0 for x in found[1])
