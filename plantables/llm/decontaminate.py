"""Benchmark decontamination: a broadcast set of test n-grams against every token window.

Benchmark items are cut into parts of a bounded number of words, so that what
is broadcast at once has a known size; nearly always there is one part. Each
part is scanned in a pass of its own over the documents, and the hits of the
passes are put together by document, so the result doesn't depend on the cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantables.llm.common import BROADCAST_IDS, cut, fresh

WINDOW = 10
#: Words of benchmark text that are broadcast at once (about 150 bytes each in a worker).
PART_WORDS = 1_000_000

#: Word characters: 0-9, a-z, and all beyond ASCII; A-Z is lowered first, the rest separates.
_TO_WORDS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

HITS = "doc_id long, which long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Windows:
    """The windows of some items, by word number."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.full: dict[tuple[int, ...], set[str]] = defaultdict(set)
        self.short: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(len(ids) - window + 1):
                self.full[tuple(ids[i : i + window])].add(item)
            if 0 < len(ids) < window:
                self.short[tuple(ids)].add(item)
        self.short_sizes = sorted({len(k) for k in self.short})
        self.short_first = {n: np.array(sorted({k[0] for k in self.short if len(k) == n})) for n in self.short_sizes}
        # full windows are told by the number of their first and last word before the tuple is looked up
        self.ends = np.array(sorted({(k[0] << 32) | k[-1] for k in self.full}), np.int64)

    def search(self, text: bytes | None) -> tuple[int, np.ndarray, list[tuple[int, int]], set[str]]:
        """Words, a mark for each hit word, the occurrences as (start, size), and the items."""
        words = words_of(text)
        n, items, places = len(words), set(), []
        hit = np.zeros(n + 1, np.int32)
        if not self.number or not n:
            return n, hit[:n] > 0, places, items
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, n)
        if not ids.any():
            return n, hit[:n] > 0, places, items
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        w = self.window
        if n >= w and len(self.ends):
            start = np.flatnonzero(unknown[w:] == unknown[:-w])
            start = start[np.isin((ids[start] << 32) | ids[start + w - 1], self.ends)] if len(start) else start
            self._verify(ids, start, w, self.full, hit, places, items)
        for size in self.short_sizes:
            if n >= size:
                start = np.flatnonzero(np.isin(ids[: n - size + 1], self.short_first[size]) & (unknown[size:] == unknown[:-size]))
                self._verify(ids, start, size, self.short, hit, places, items)
        return n, np.cumsum(hit)[:n] > 0, places, items

    @staticmethod
    def _verify(ids, starts, size, table, hit, places, items) -> None:
        for i in starts.tolist():
            if found := table.get(tuple(ids[i : i + size].tolist())):
                hit[i] += 1
                hit[i + size] -= 1
                places.append((i, size))
                items |= found


def _spans(mark: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Item texts in parts of about part_words words; an item is whole. Comes to the driver part by part."""
    part, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null and item_id is not null").distinct().toLocalIterator():
        part.append((r.item_id, bytes(r.text)))
        held += len(words_of(bytes(r.text)))
        if held >= part_words:
            yield part
            part, held = [], 0
    if part:
        yield part


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(given):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = given.value
        for b in batches:
            out = [windows.search(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([int(x[1].sum()) for x in out], pa.int64()),
                    pa.array([_spans(x[1]) for x in out], _SPANS),
                    pa.array([sorted(x[3]) for x in out], pa.list_(pa.string())),
                ],
                ["doc_id", "which", "n_words", "n_hit", "spans", "items"],
            )

    return rows


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> one row for each document row:
    doc_id, which (hash of the text), n_words, n_hit (words inside any
    occurrence), spans of hit words [start, end), items.

    Null and wordless texts have no words and no hits; items without an id or
    words are left out; an empty benchmark gives no hits. Rows that repeat
    count each by itself. Items of one id put their windows together. Only
    the named columns are read; others may clash.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("which"), F.col("text").cast("string").cast("binary").alias("text"))
    parts = _parts(benchmark, part_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return text.mapInArrow(_scanner(spark.sparkContext.broadcast(Windows(first, window))), HITS)
    held = []
    for part in chain([first, second], parts):
        given = spark.sparkContext.broadcast(Windows(part, window))
        held.append(cut(text.mapInArrow(_scanner(given), HITS), "hits"))
        given.destroy()
    return _together(reduce(DataFrame.unionByName, held), len(held))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, counts = [], []
        for found in b.column(3).to_pylist():
            edges = sorted((x["start"], x["end"]) for some in found for x in some)
            whole: list[list[int]] = []
            for start, end in edges:
                if whole and start <= whole[-1][1]:
                    whole[-1][1] = max(end, whole[-1][1])
                else:
                    whole.append([start, end])
            spans.append([{"start": x, "end": y} for x, y in whole])
            counts.append(sum(y - x for x, y in whole))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), b.column(4)], ["doc_id", "which", "n_words", "n_hit", "spans", "items"])


def _together(found: DataFrame, passes: int) -> DataFrame:
    """Hits of several passes put together; rows that repeat come out as often as they went in."""
    merged = found.groupBy("doc_id", "which", "n_words").agg(
        F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows")
    )
    each = merged.select("doc_id", "which", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), (F.col("rows") / passes).cast("int"))))
    return each.drop("col").mapInArrow(_union, HITS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The documents without any hit; all their columns. Contaminated ones go whole."""
    dirty = cut(hits(docs, benchmark, window, part_words).filter("n_hit > 0").select("doc_id", "which").distinct(), "contaminated")
    own, which, of, hit = fresh(docs, "__own", "__which", "__id", "__hit")
    named = docs.withColumns({own: F.col("doc_id").cast("long"), which: F.xxhash64(F.col("text").cast("string"))})
    few = dirty.count() * len(dirty.columns) <= BROADCAST_IDS
    dirty = dirty.select(F.col("doc_id").alias(of), F.col("which").alias(hit))
    on = F.col(own).eqNullSafe(F.col(of)) & (F.col(which) == F.col(hit))
    return named.join(F.broadcast(dirty) if few else dirty, on, "left_anti").drop(own, which)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): the words of each document that no occurrence covers, lower-cased, with one space between."""
    found = hits(docs, benchmark, window).filter("n_hit > 0").select("doc_id", "which", "spans").dropDuplicates(["doc_id", "which"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if spans:
                    words, keep, at = words_of(text), [], 0
                    for x in spans:
                        keep += words[at : x["start"]]
                        at = x["end"]
                    text = b" ".join(keep + words[at:])
                kept.append(None if text is None else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("which").alias("__hit"), "spans")
    joined = text.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hit")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(drop, "doc_id long, text string")
