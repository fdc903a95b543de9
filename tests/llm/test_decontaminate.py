import re

from plantables.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, items):
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for g in {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} if w else set()):
            for i in range(len(doc) - len(g) + 1):
                if tuple(doc[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


ITEMS = [(1, "What is the Answer to life, the universe and all the rest of it?"), (2, "short one"), (3, None), (4, "..."), (5, "a a a a a a a a a a a a"), (6, "What is the Answer to life, the universe and all"), (7, "é ü ñ")]
TEXTS = [
    "x what is the answer to life the universe and all the rest of it y",
    "SHORT-one and short one", "", None, "a " * 40, "é ü ñ É ü ñ", "What is the answer to life, the universe and nothing", "a a a a a a a a a", "short",
    "word " * 20_000 + "short one",
]


def test_hits_match_brute_force_whatever_the_parts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for part_words in (1_000_000, 5):
        got = D.hits(docs, items, part_words=part_words).collect()
        assert len(got) == len(TEXTS) + 1
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == plain(TEXTS[r.doc_id], ITEMS), (r.doc_id, part_words)
            assert sum(s.end - s.start for s in r.spans) == r.n_hit
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not plain(t, ITEMS)[1]]
    assert {r.text for r in D.without_spans(docs, items).collect() if r.doc_id == 0} == {"x y"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.hits(docs, items).collect()] == [(2, 0)]
    assert D.hits(docs.limit(0), items).count() == 0
