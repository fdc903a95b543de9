import re

from plantables.llm import licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


NOTICE = licenses.PASSAGES["mit-notice"].split()
TEXTS = [
    "Released under the MIT License.", "mit mit license license MIT-LICENSE", "general public license general public", "General\x00Public_License", "", None, "...", "mit", "license",
    "x " * 30_000 + "apache license", "Apache License, MIT license; GNU General Public License v3", "mit licénse mit license", " ".join(NOTICE), " ".join(NOTICE[:12] + ["added"] + NOTICE[12:20] + NOTICE[21:]),
    "words before " + " ".join(NOTICE[:8]), "Licensed under CC BY-NC 4.0.", "Ä mit license ß", "public license general public license",
]


def test_base_matches_brute_force_and_passages_are_found(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 1), (None, TEXTS[0], "y", 2)], "doc_id long, text string, labels string, w int")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(TEXTS[r.doc_id or 0]), r.doc_id
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r["labels"].split(","))
    got = {r.doc_id: r for r in rows}
    assert got[0]["labels"] == "mit,mit-released" and got[0].score == 1.0
    assert got[12]["labels"] == "mit-notice" and (got[12].spans[0].start, got[12].spans[0].end) == (0, len(NOTICE))
    assert got[13]["labels"] == "mit-notice" and len(got[13].spans) == 1 and got[13].score >= 0.6
    assert got[14]["labels"] == "" and got[14].score == 0.0
    assert got[15]["labels"] == "cc-by-nc"
    assert licenses.scan(docs.limit(0)).count() == 0
