from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantables.llm import langid


def plain_ngrams(text):
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = Counter()
    for word in kept.split():
        w = f" {word} "
        out.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip() and not (n == 3 and g[1] == " "))
    return out


def code(gram):
    return sum((0 if c == " " else ord(c)) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))


def test_ngrams_match_plain_counts(monkeypatch):
    for slab in (1 << 20, 5, 3):
        monkeypatch.setattr(langid, "SLAB", slab)
        for text in (None, "", "12 !?", "a", "ab c", "Größe, ñandú-42 x", "the quick brown fox " * 3, "  a  b  "):
            want = Counter()
            for g, n in plain_ngrams(text).items():
                want[code(g)] += n
            grams, counts = langid.ngrams(text)
            assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want, (text, slab)


def test_distance_and_ties():
    p = langid.Profiles([("b", 1, 0), ("a", 1, 0), ("a", 2, 1)], 10)
    assert p.langs == ["a", "b"]
    assert p.predict(None) == ("und", 0.0)
    assert p.predict("123") == ("und", 0.0)
    assert p.predict("xyz")[0] == "a"
    assert langid.Profiles([], 10).predict("abc") == ("und", 0.0)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(docs).join(docs, "doc_id").filter(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "...", None), (2, "...", None), (None, "the and of", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(odd).collect() if r.doc_id] == [("und", 0.0)] * 3
    assert langid.identify(odd.limit(0)).count() == 0
    assert langid.known(docs.limit(5)).columns == docs.columns


def plain_ranked(text, size):
    counts = Counter()
    for g, n in plain_ngrams(text).items():
        counts[code(g)] += n
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


def test_distances_match_brute_force():
    texts = {"a": "the thing and the other " * 3, "b": "der und die das schön über", "c": "x y z"}
    size = 30
    rows = [(lang, g, r) for lang, t in texts.items() for r, g in enumerate(plain_ranked(t, size))]
    profiles = langid.Profiles(rows, size)
    for text in (*texts.values(), "the und thing", "Привет", "a", "the " * 3000 + "über", "ÄÖ the"):
        own = plain_ranked(text, size)
        assert langid.ranked(text, size).tolist() == own
        away = {}
        for lang in texts:
            place = {g: r for one, g, r in rows if one == lang}
            away[lang] = sum(abs(i - place[g]) if g in place else size for i, g in enumerate(own))
        best = min(sorted(away), key=away.get)
        assert profiles.predict(text) == (best, pytest.approx(1 - away[best] / (size * len(own))))


def test_unknown_languages_go(spark):
    learned = [(i, "the thing and the other of it", "en") for i in range(30)] + [(100 + i, "der und die das nicht ist", "de") for i in range(30)]
    asked = [(1001, "Привет мир снова", None), (1002, "12 34", None), (1003, None, None), (1004, "the other thing", None), (1005, "", "en"), (1006, "die und der " * 50_000, "de")]
    docs = spark.createDataFrame(learned + asked, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("which", "score", "lang_pred", "gram", "share")})
    kept = langid.known(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in learned} | {1004, 1006}
    assert {r.doc_id for r in langid.known(docs, wanted=frozenset({"de"})).collect()} == {100 + i for i in range(30)} | {1006}
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert found[1002] == found[1003] == found[1005] == ("und", 0.0) and found[1006][0] == "de" and found[1001][1] == 0.0
