"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of a language's most frequent n-grams of one to
three letters, word edges included. A document's own ranked list is compared
with each by out-of-place distance: how far each n-gram stands from its place
in the profile, the list's length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
#: Profiles are learned from about so many labelled documents of a language (all, if fewer), taken by a hash of their id.
SAMPLE_PER_LANG = 3000
UNKNOWN = "und"
#: Least score of a document in a known language: where a text has the profile's n-grams at all, it is above
#: 0.4 on documents of the labelled languages; a text of another script has 0.
LEAST_SCORE = 0.2
#: Characters whose n-grams are counted at a time.
SLAB = 1 << 20


@cache
def _letter() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _count(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(codes, return_counts=True)
    grams, where = np.unique(codes, return_inverse=True)
    return grams, np.bincount(where, times, len(grams)).astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a whole text as numbers (21 bits a character, 0 for a word edge), with their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    found = []
    for i in range(0, len(points), SLAB):
        part = points[max(0, i - 2) : i + SLAB].astype(np.int64)
        part = np.where(_letter()[part], part, 0)
        edge, fresh = np.zeros(1, np.int64), min(i, 2)
        part = np.concatenate([edge if i == 0 else edge[:0], part, edge if i + SLAB >= len(points) else edge[:0]])
        fresh += i == 0
        one, two = part[max(fresh, 0) :], (part[:-1] << 21 | part[1:])[max(fresh - 1, 0) :]
        three = ((part[:-2] << 42) | (part[1:-1] << 21) | part[2:])[max(fresh - 2, 0) :]
        middle = part[1:-1][max(fresh - 2, 0) :]
        one, two, three = one[one > 0], two[two > 0], three[middle > 0]
        found.append(_count(np.concatenate([one, two, three])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _count(*(np.concatenate(x) for x in zip(*found, strict=True)))


def ranked(text: str | None, size: int) -> np.ndarray:
    """The most frequent n-grams, first the most frequent; ties by number."""
    grams, counts = ngrams(text)
    if len(grams) > size:
        least = np.partition(counts, -size)[-size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, size: int = PROFILE, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Labelled documents(doc_id, text, lang) -> (lang, gram, rank from 0), `size` rows a language at most.

    Rows without lang or text teach nothing. Each document of a language is
    taken with the chance that makes about per_lang of them, by a hash of
    doc_id; what is broadcast for that is a row a language; n-grams are summed within each task before they are shuffled.
    """
    usable = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    share = usable.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share"))
    lot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("profile")), F.lit(1_000_000)) / 1_000_000
    sample = usable.join(F.broadcast(share), "lang").filter(lot < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pd.DataFrame({"lang": b.column(0).to_pylist(), "text": b.column(1).to_pylist()})
            for lang, some in rows.groupby("lang"):
                counted = [ngrams(t) for t in some["text"]]
                grams, counts = _count(*(np.concatenate(x) for x in zip(*counted, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.select("lang", "gram", F.row_number().over(order).alias("r")).filter(F.col("r") <= size).select("lang", "gram", (F.col("r") - 1).alias("rank"))


class Profiles:
    """Profiles of some languages as one table: sorted n-grams, and their rank by language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        at, col = {g: i for i, g in enumerate(self.grams.tolist())}, {x: i for i, x in enumerate(self.langs)}
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.rank[at[gram], col[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 less its distance, as a part of the largest possible; ties to the first name."""
        own = ranked(text, self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        i = np.searchsorted(self.grams, own)
        i[self.grams[np.minimum(i, len(self.grams) - 1)] != own] = len(self.grams)
        rank = self.rank[i]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """documents(doc_id, text) and learn()'s rows -> (doc_id, which, lang_pred, score), a row for each row.

    which is xxhash64 of the text. Null texts, texts without a letter, and all
    texts where nothing was learned get "und" and 0. Only the text is used.
    Profiles are `size` rows a language, so what is broadcast grows only with
    the number of languages.
    """
    given = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()], size))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [given.value.predict(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "which", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("which"), text.alias("text")).mapInArrow(scan, "doc_id long, which long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict() for all documents, by profiles of those that aren't held out."""
    return predict(docs, learn(docs.filter(~held_out(F.col("doc_id")))))


def known(docs: DataFrame, least_score: float = LEAST_SCORE, wanted: frozenset[str] | None = None) -> DataFrame:
    """The documents in a learned language; all their columns.

    A document goes if its prediction is "und" (null, or no letter), if the
    score of the nearest language is below least_score (letters of another
    script, or of no language), or if that language isn't among those wanted.
    """
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))))
    given = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.collect()], PROFILE))

    def stays(lang: str, score: float) -> bool:
        return lang != UNKNOWN and score >= least_score and (wanted is None or lang in wanted)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: stays(*given.value.predict(x)))

    return docs.filter(found(F.col("text").cast("string")))
