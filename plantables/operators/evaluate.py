"""Alignment and evaluation: edit counts, error rates, keyed alignment, field and answer scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantables.functions.text import credits_match, normalize_credits_text, normalize_prerequisite, normalize_text
from plantables.sources.scratch import written

COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("distance", "sub", "del", "ins")])


def edits(ref: Sequence, hyp: Sequence) -> tuple[int, int, int, int]:
    """Least edits from ref to hyp; among equal ones a match or substitution before a deletion before an insertion.

    Counts go along with each cell, so two rows of them are enough.
    """
    last = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, a in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, b in enumerate(hyp, 1):
            d, s, x, y = last[j - 1]
            best = (d, s, x, y) if a == b else (d + 1, s + 1, x, y)
            if a != b:
                d, s, x, y = last[j]
                if d + 1 < best[0]:
                    best = (d + 1, s, x + 1, y)
                d, s, x, y = row[j - 1]
                if d + 1 < best[0]:
                    best = (d + 1, s, x, y + 1)
            row.append(best)
        last = row
    return last[-1]


@F.pandas_udf(COUNTS)
def edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """A1 over characters; give it distinct unequal pairs only."""
    return pd.DataFrame([edits(a or "", b or "") for a, b in zip(ref, hyp, strict=True)], columns=["distance", "sub", "del", "ins"])


@F.pandas_udf(COUNTS)
def word_edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """A1 over white-space words."""
    return pd.DataFrame([edits((a or "").split(), (b or "").split()) for a, b in zip(ref, hyp, strict=True)], columns=["distance", "sub", "del", "ins"])


def with_edits(pairs: DataFrame, ref: str, hyp: str, words: bool = False) -> DataFrame:
    """A1: pairs with their counts; each distinct unequal pair is compared once."""
    unequal = pairs.filter(F.col(ref) != F.col(hyp)).select(ref, hyp).distinct()
    done = unequal.withColumn("e", (word_edit_counts if words else edit_counts)(ref, hyp)).select(ref, hyp, "e.*")
    zero = F.lit(0)
    return pairs.join(done, [ref, hyp], "left").withColumns({n: F.coalesce(n, zero) for n in ("distance", "sub", "del", "ins")})


def error_rate(distance: Column, ref_length: Column, hyp_length: Column) -> Column:
    """A2: distance by the reference's length; without one 0 if the other is empty too, else 1."""
    return F.when(ref_length > 0, distance / ref_length).otherwise(F.when(hyp_length > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def _rate(errors: str, length: str) -> Column:
    return F.round(F.when(F.col(length) > 0, F.col(errors) / F.col(length)).otherwise(F.lit(0.0)), 6)


def field_stats(pairs: DataFrame, fields: list[str], words: list[str] | None = None, key: str | None = None, samples: int = 5, missed: str | None = None, exempt: list[str] | None = None) -> DataFrame:
    """A3: truth_f and pred_f columns -> by field: items, exact, missing, hallucinated, errors (sub, del, ins), length, cer,
    word errors and wer for the fields in `words`, and the first few unlike pairs by key.

    Texts are compared by F1's strict form, words by its word form. Each
    distinct unlike pair is aligned once. Rows where `missed` holds don't
    count for the exempt fields.
    """
    text = lambda side, name: F.coalesce(F.col(f"{side}_{name}").cast("string"), F.lit(""))
    at = F.col(key).cast("string") if key else F.lit("")
    gone = F.coalesce(F.col(missed), F.lit(False)) if missed else F.lit(False)
    parts = F.array(*(F.struct(F.lit(f).alias("field"), text("truth", f).alias("r"), text("pred", f).alias("h"), F.lit(f in (words or [])).alias("worded"), (gone & F.lit(f in (exempt or []))).alias("exempt")) for f in fields))
    each = pairs.select(at.alias("key"), F.explode(parts).alias("x")).select("key", "x.*").filter(~F.col("exempt"))
    each = each.groupBy("field", "worded", "r", "h").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    each = each.withColumns({"ref": normalize_text(F.col("r"), "strict"), "hyp": normalize_text(F.col("h"), "strict"), "wr": normalize_text(F.col("r"), "word"), "wh": normalize_text(F.col("h"), "word")})
    unlike = F.col("ref") != F.col("hyp")
    aligned = each.withColumns({"e": F.when(unlike, edit_counts("ref", "hyp")), "w": F.when(F.col("worded") & (F.col("wr") != F.col("wh")), word_edit_counts("wr", "wh"))})
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)) * F.col("n"))
    n_words = F.when(F.col("worded") & (F.col("wr") != ""), F.size(F.split("wr", " ")))
    sums = aligned.groupBy("field").agg(
        F.sum("n").alias("items"),
        total((~unlike).cast("int")).alias("exact"),
        total(((F.col("ref") != "") & (F.col("hyp") == "")).cast("int")).alias("missing"),
        total(((F.col("ref") == "") & (F.col("hyp") != "")).cast("int")).alias("hallucinated"),
        total(F.col("e.distance")).alias("errors"),
        *(total(F.col("e")[x]).alias(x) for x in ("sub", "del", "ins")),
        total(F.length("ref")).alias("ref_length"),
        total(F.col("w.distance")).alias("word_errors"),
        total(n_words).alias("ref_words"),
    )
    first = Window.partitionBy("field").orderBy("key", "r", "h")
    few = aligned.filter(unlike).withColumn("i", F.row_number().over(first)).filter(F.col("i") <= samples)
    shown = few.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("i", "key", "r", "h"))).alias("s")).select("field", F.transform("s", lambda x: F.struct(x["key"].alias("key"), x["r"].alias("truth"), x["h"].alias("pred"))).alias("samples"))
    return sums.withColumns({"cer": _rate("errors", "ref_length"), "wer": _rate("word_errors", "ref_words")}).join(shown, "field", "left")


def overall(stats: DataFrame) -> DataFrame:
    """A3: micro rates over all fields' sums, and macro rates, the mean over fields that have items."""
    sums = stats.filter("items > 0").agg(
        *(F.sum(c).alias(c) for c in ("items", "exact", "errors", "ref_length", "word_errors", "ref_words")), F.round(F.avg("cer"), 6).alias("macro_cer"), F.round(F.avg("wer"), 6).alias("macro_wer"), F.round(F.avg(F.col("exact") / F.col("items")), 6).alias("macro_exact")
    )
    return sums.withColumns({"micro_cer": _rate("errors", "ref_length"), "micro_wer": _rate("word_errors", "ref_words"), "micro_exact": _rate("exact", "items")})


def _numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def align_by_key(truth: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """A4: (key, t_id, p_id): the n-th row of a key in truth with its n-th in the prediction, ids null where there is none.

    Both have `ordinal`. Keys are compared null-safely by their text.
    """
    k = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    t = _numbered(truth.select(k.alias("key"), F.col("ordinal").alias("t_id")), ["key"], ["t_id"])
    p = _numbered(pred.select(k.alias("key"), F.col("ordinal").alias("p_id")), ["key"], ["p_id"])
    return t.join(p, ["key", "__n"], "full").select("key", "t_id", "p_id")


def scores(pairs: DataFrame) -> DataFrame:
    """A4: matched, missed and spurious pairs, precision, recall and F1; 0 where undefined."""
    sums = pairs.agg(F.count_if(F.col("t_id").isNotNull() & F.col("p_id").isNotNull()).alias("matched"), F.count_if(F.col("p_id").isNull()).alias("missed"), F.count_if(F.col("t_id").isNull()).alias("spurious"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    out = sums.withColumn("precision", part("matched", "spurious")).withColumn("recall", part("matched", "missed"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def align_rows(truth: DataFrame, pred: DataFrame, passes: list[list[str]], fields: Sequence[str] = ()) -> DataFrame:
    """The pairs of align_multipass() with the fields of both rows, truth_f and pred_f, null where there is no row.

    A pass is one full join, which tells its pairs and what it leaves on both
    sides; it is written, but for the last, and carries the later keys, first
    appearances and fields along, so that neither table is read again.
    """
    keys = [F.to_json(F.struct(*key), {"ignoreNullFields": "false"}) for key in passes]
    names = [f"__k{i}" for i in range(len(passes))]
    rest_t = truth.select(F.col("ordinal").alias("t_id"), *(k.alias(n) for k, n in zip(keys, names, strict=True)), *(F.col(x).alias(f"truth_{x}") for x in fields))
    rest_p = pred.select(F.col("ordinal").alias("p_id"), *(k.alias(n) for k, n in zip(keys, names, strict=True)), *(F.col(x).alias(f"pred_{x}") for x in fields))
    leads = [f"__lead{i}" for i in range(len(passes) - 1)]
    rest_p = rest_p.withColumns({lead: F.min("p_id").over(Window.partitionBy(n)) for lead, n in zip(leads, names, strict=False)})
    shown = ["t_id", "p_id", *(f"truth_{x}" for x in fields), *(f"pred_{x}" for x in fields)]
    found = None
    for i, key in enumerate(names):
        final = i == len(names) - 1
        later, order = names[i + 1 :], ["p_id"] if i == 0 else [f"__lead{i - 1}", "p_id"]
        t = _numbered(rest_t, [key], ["t_id"]).withColumnsRenamed({n: f"__t{n}" for n in later})
        p = _numbered(rest_p, [key], order).withColumnsRenamed({n: f"__p{n}" for n in later})
        both = t.join(p, [key, "__n"], "full").drop("__n", key)
        both = both if final else written(both, "aligned")
        met = F.col("t_id").isNotNull() & F.col("p_id").isNotNull()
        ended = both if final else both.filter(met)
        ended = ended.select(F.when(met, F.lit(i)).otherwise(F.lit(len(names))).alias("pass"), *shown)
        found = ended if found is None else found.unionByName(ended)
        if not final:
            rest_t = both.filter("p_id is null").select("t_id", *(F.col(f"__t{n}").alias(n) for n in later), *(f"truth_{x}" for x in fields))
            rest_p = both.filter("t_id is null").select("p_id", *(F.col(f"__p{n}").alias(n) for n in later), *leads[i:], *(f"pred_{x}" for x in fields))
    return found


def align_multipass(truth: DataFrame, pred: DataFrame, passes: list[list[str]]) -> DataFrame:
    """A5: pass after pass on what is left; left-over predictions go by their last key's first appearance, then ordinal.

    -> (pass, t_id, p_id); what no pass aligned has the number of passes.
    """
    return align_rows(truth, pred, passes).select("pass", "t_id", "p_id")


def field_value(name: str, c: Column) -> Column:
    """A value as it is compared: credits by F11 or without spaces, prerequisites as a set of codes, a year or semester 0 as none."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    if name == "credits":
        return F.coalesce(F.nullif(normalize_credits_text(text), F.lit("")), F.regexp_replace(text, r"\s+", ""))
    if name == "prerequisite":
        return normalize_prerequisite(text)
    if name in ("year", "semester"):
        number = F.regexp_extract(text, "-?[0-9]+", 0)
        return F.when(number == "0", "").otherwise(number)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def evaluate_fields(truth: DataFrame, pred: DataFrame, key: list[str], fields: list[str], examples: int = 10) -> DataFrame:
    """By field over the union of keys, and "all": alike is a hit, unlike both a false one and a miss, one side a miss or a
    false one, none nothing. Credits are alike by F13. Also the first few unlike keys.

    "code" may be among the fields: then it is whether the key itself is on both sides.
    """
    own = [f for f in fields if f != "code"]
    t = truth.select(*key, *(field_value(f, F.col(f)).alias(f"t_{f}") for f in own), F.lit("1").alias("t_code"))
    p = pred.select(*key, *(field_value(f, F.col(f)).alias(f"p_{f}") for f in own), F.lit("1").alias("p_code"))
    both = t.join(p, key, "full").withColumn("__at", F.concat_ws("|", *key))
    value = lambda side, f: F.coalesce(F.col(f"{side}_{f}"), F.lit(""))
    same = lambda f: (value("t", f) != "") & (value("p", f) != "") & (credits_match(value("t", f), value("p", f)) if f == "credits" else value("t", f) == value("p", f))
    each = both.select("__at", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), value("t", f).alias("t"), value("p", f).alias("p"), same(f).alias("same")) for f in fields))).alias("x")).select("__at", "x.*")
    unlike = ~F.col("same") & ((F.col("t") != "") | (F.col("p") != ""))
    sums = each.groupBy("field").agg(F.count_if("same").alias("tp"), F.count_if(unlike & (F.col("p") != "")).alias("fp"), F.count_if(unlike & (F.col("t") != "")).alias("fn"))
    sums = sums.unionByName(sums.agg(F.lit("all").alias("field"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    band = F.when(F.col("f1") > 0.91, "high").when(F.col("f1") >= 0.80, "fair").otherwise("low")
    few = each.filter(unlike).withColumn("i", F.row_number().over(Window.partitionBy("field").orderBy("__at", "t", "p"))).filter(F.col("i") <= examples)
    shown = few.groupBy("field").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "__at", F.concat_ws(" / ", "t", "p")))).alias("examples"))
    return sums.withColumn("f1", F.round(f1, 6)).withColumn("band", band).join(shown, "field", "left")


def score_answers(expected: DataFrame, got: DataFrame) -> DataFrame:
    """expected(question, type, value array<string>), got(question, value) rows -> question and correct.

    value: the value is among the got ones; set: all wanted are; count: as many
    rows; none: no row. Rows of null only are none.
    """
    rows = got.filter("value is not null").groupBy("question").agg(F.collect_set("value").alias("values"), F.count("*").alias("n"))
    joined = expected.join(rows, "question", "left").withColumns({"values": F.coalesce("values", F.array().cast("array<string>")), "n": F.coalesce("n", F.lit(0).cast("long"))})
    right = (
        F.when(F.col("type").isin("value", "set"), F.size(F.array_except("value", "values")) == 0)
        .when(F.col("type") == "count", F.get("value", F.lit(0)).try_cast("long") == F.col("n"))
        .when(F.col("type") == "none", F.col("n") == 0)
    )
    return joined.select("question", "type", F.coalesce(right, F.lit(False)).alias("correct"))


def score_summary(answers: DataFrame, by: list[str]) -> DataFrame:
    """answers(by, executed, n_rows, n_pages, correct) -> by level and over all: how many, executed, correct and answerable
    ones, their parts, and the part of the answerable ones that cite pages."""
    sums = answers.rollup(*by).agg(
        F.count("*").alias("n"), F.count_if("executed").alias("n_executed"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("n_rows") > 0).alias("n_answerable"), F.count_if((F.col("n_rows") > 0) & (F.col("n_pages") > 0)).alias("n_cited")
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return sums.withColumns({"executed_rate": rate("n_executed", "n"), "rate": rate("n_correct", "n"), "cited_rate": rate("n_cited", "n_answerable")})
