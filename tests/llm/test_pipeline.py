import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from plantables.llm import common, langid  # noqa: E402
from tests.llm.test_decontaminate import plain as plain_hits  # noqa: E402
from tests.llm.test_mixing import plain_mix  # noqa: E402
from tests.llm.test_similar import plain_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_run(spark, rows, items, profiles):
    """{row index: least and most times in the result} of the stages, all rows compared."""

    def stays(text):
        lang, score = profiles.predict(text)
        return lang != "und" and score >= langid.LEAST_SCORE

    kept = [i for i, r in enumerate(rows) if stays(r.text)]
    component = plain_components([(i, rows[i].text) for i in kept])
    kept = [i for i in kept if component[i] == i]
    kept = [i for i in kept if not plain_hits(rows[i].text, items)[1]]
    tokens = Counter()
    for i in kept:
        tokens[rows[i].source or ""] += len(rows[i].text.encode().split()) + 1
    _, weights, budget = plain_mix(dict(tokens), corpus_pipeline.REPEATS)
    repeats = {s: budget * w / tokens[s] for s, w in weights.items()}
    return {i: (int(repeats[rows[i].source or ""] - 1e-9), int(repeats[rows[i].source or ""] + 1 - 1e-9)) for i in kept}


def checked(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    profiles = langid.Profiles([tuple(r) for r in langid.learn(docs.filter(~langid.held_out(docs["doc_id"]))).collect()], langid.PROFILE)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_run(spark, rows, items, profiles)
    before = set(common._made)
    out = corpus_pipeline.run(spark, folder)
    assert len(set(common._made) - before) == 1  # the result alone is left in the shared folder
    assert out.columns == [c for c in docs.columns if c not in ("law", "shard", "slot")] + ["law", "shard", "slot"]
    got = out.collect()
    times = Counter((r.doc_id, r.text, r.source) for r in got)
    assert set(times) == {(rows[i].doc_id, rows[i].text, rows[i].source) for i in want}
    for i, (least, most) in want.items():
        assert least <= times[(rows[i].doc_id, rows[i].text, rows[i].source)] <= most
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1 and set(shards) <= set(range(16))
    for s in shards:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(shards[s]))
    return rows, want


def test_stages_match_brute_force(spark):
    checked(spark, SF)


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [
        (9001, None, "en", "src1"), (9002, "", "en", "src1"), (9003, "123 456 !!", None, None), (9004, "Привет мир снова и снова", "en", "src2"),
        (9005, "the and of " * 4_000, "en", "src1"), (9006, f"the and {item} of the", "en", "src3"), (9007, "the thing and the other thing of it all", None, None),
        (9007, "another of the things that are under one id", "en", "src1"), (9007, "another of the things that are under one id", "en", "src1"),
    ]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    clash = {c: F.lit("x") for c in ("which", "head", "fp", "slot", "block", "__id")}
    docs.unionByName(more.select(docs.columns)).withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, want = checked(spark, tmp_path)
    stayed = Counter(rows[i].doc_id for i in want if rows[i].doc_id > 9000)
    assert stayed == {9005: 1, 9007: 2}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda x: x[0])
def test_stages_return_the_columns_of_documents(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage[1](spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
