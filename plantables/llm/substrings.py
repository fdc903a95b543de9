"""Exact substring dedup by recompression.

Rounds name runs of equal symbols and pairs of neighbouring ones, words at
first. A pair is named where its first symbol falls into one half of the
symbols and its second into the other, by a hash bit that differs from round
to round. A name is a hash of what it stands for, so it is the same in all
documents, and whether a symbol arises depends on nearby words only: each
carries the stretch of words it depends on. Every window of words is filed
under the highest symbol that depends on nothing outside it; equal windows
are filed alike. Windows filed alike in a row are one stretch. So a symbol
that is met once rules its windows out, an equal stretch settles its windows
at once, and only windows where a repeat begins or ends are compared one by
one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantables.llm.common import Cut, cut, only_ids

WINDOW = 35
#: Rounds: "run" names runs, "pair" pairs. Symbols of later rounds would depend on more than a window.
ROUNDS = ("run", "pair", "pair", "pair", "run", "pair", "pair", "pair", "pair")
#: Words parsed together, of many documents or of one that is longer.
TOGETHER = 1 << 18

_ODD1, _ODD2, _ODD3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASES = (0x27220A95FE1D83D5, 0x8CB92BA72F3D8DD7)

FILED = "did long, key long, stretch long, start int, windows int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD1
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(1)), np.uint64, len(words))


class Sums:
    """Hashes of any range of words, from running sums of words times powers (modulo 2**64)."""

    def __init__(self, words: np.ndarray, base: int):
        power = np.full(len(words) + 1, np.uint64(base))
        power[0] = 1
        self.back = np.full(len(words) + 1, np.uint64(pow(base, -1, 1 << 64)))
        self.back[0] = 1
        power, self.back = np.cumprod(power), np.cumprod(self.back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words) * power[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _ODD3)


def rounds(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each round, words at first: name, and the words [a, b) each depends on.

    first, last: for each word, where its document begins and ends. What
    depends on a document's edge is given a word beyond it.
    """
    at = np.arange(len(words))
    name, a, b = words, at, at + 1
    lo, hi = first, last
    yield name, a, b
    for r, kind in enumerate(ROUNDS):
        n = len(name)
        if n < 2:
            return
        same_doc = lo[1:] == lo[:-1]
        before = np.concatenate([[lo[0] - 1], np.where(same_doc, a[:-1], lo[1:] - 1)])
        after = np.concatenate([np.where(same_doc, b[1:], hi[:-1] + 1), [hi[-1] + 1]])
        if kind == "run":
            start = np.flatnonzero(np.concatenate([[True], ~((name[1:] == name[:-1]) & same_doc)]))
            size = np.diff(np.append(start, n))
            end = start + size - 1
            named = np.where(size > 1, _mix(name[start] + size.astype(np.uint64) * _ODD3 + np.uint64(r + 1)), name[start])
            name, a, b, lo, hi = named, before[start], after[end], lo[start], hi[start]
        else:
            left = (_mix(name ^ np.uint64(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
            joins = np.zeros(n, bool)
            joins[:-1] = left[:-1] & ~left[1:] & same_doc
            taken = np.zeros(n, bool)
            taken[1:] = joins[:-1]
            keep = np.flatnonzero(~taken)
            pair = joins[keep]
            nxt = np.minimum(keep + 1, n - 1)
            named = np.where(pair, _mix(_mix(name[keep] + np.uint64(r + 1)) * _ODD3 + name[nxt]), name[keep])
            new_a = np.where(left[keep], a[keep], before[keep])
            new_b = np.where(pair, b[nxt], np.where(left[keep], after[keep], b[keep]))
            name, a, b, lo, hi = named, new_a, new_b, lo[keep], hi[keep]
        yield name, a, b


def file_windows(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Words of some documents, one after the other -> for each stretch: document, key, hash of its words, start, windows."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words))
    starts = at[at + window <= ends[doc]]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
    key, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for level, (name, a, b) in reversed(list(enumerate(rounds(words, begins[doc], ends[doc])))):
        w = starts[open_]
        i = np.searchsorted(a, w)
        j = np.minimum(i, len(a) - 1)
        fits = (i < len(a)) & (b[j] <= w + window)
        got, j = open_[fits], j[fits]
        key[got] = _mix(name[j] + np.uint64(level * int(_ODD2) & (1 << 64) - 1))
        place[got] = level << 40 | j
        open_ = open_[~fits]
        if not len(open_):
            break
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(fresh, len(starts)))
    s = starts[fresh]
    stretch = Sums(words, _BASES[0]).of(s, s + count - 1 + window)
    return doc[s], key[fresh].view(np.int64), stretch.view(np.int64), (s - begins[doc[s]]).astype(np.int32), count.astype(np.int32)


def _filed(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            held: list[np.ndarray] = []
            where: list[int] = []

            def flush():
                doc, *rest = file_windows(np.concatenate(held), np.array([len(x) for x in held]), window)
                out = [pa.array(ids[np.array(where)][doc], pa.int64()), *(pa.array(x) for x in rest)]
                held.clear()
                where.clear()
                return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in FILED.split(", ")])

            total = 0
            for row, text in enumerate(b.column(1)):
                words = words_of(text.as_py())
                if len(words) >= window:
                    held.append(hashes(words))
                    where.append(row)
                    total += len(words)
                if total >= TOGETHER:
                    yield flush()
                    total = 0
            if held:
                yield flush()

    return scan


def _windows(window: int):
    """(did, text, spans of windows) -> both hashes of each of those windows, with its place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for did, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = hashes(words_of(text.as_py()))
                at = np.concatenate([np.arange(x["start"], x["start"] + x["windows"]) for x in spans])
                h = [Sums(words, base).of(at, at + window).view(np.int64) for base in _BASES]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(at), did)), pa.array(at.astype(np.int32))], ["h1", "h2", "did", "start"])

    return scan


def _kept(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                gone = np.zeros(len(words) + 1, np.int32)
                for x in spans or ():
                    gone[x["start"]] += 1
                    gone[x["start"] + x["windows"] - 1 + window] -= 1
                n.append(len(words))
                if spans:
                    stays = np.cumsum(gone)[:-1] == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return scan


def _identity(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and did, which tells documents apart: doc_id, or a hash of it and the text where ids repeat or are null."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    plain = not text.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").head(1)
    did = F.col("doc_id") if plain else F.xxhash64("doc_id", "text")
    return text.select("doc_id", F.col("text").cast("binary").alias("text"), did.alias("did")), plain


def repeated(text: DataFrame, window: int = WINDOW) -> DataFrame:
    """(did, text) -> (did, spans of (start, windows)): the windows whose words also start anywhere else, by document.

    Symbols, stretches and windows are counted by hash keys after sums within
    tasks, and joined back; a passage that a third of all documents holds is
    split by Spark as any large key of a join.
    """
    filed = Cut(text.select("did", "text").mapInArrow(_filed(window), FILED), "filed")
    # counts are written before they are joined: a join that shares its stage with a sum isn't split where a key is large
    often = Cut(filed.df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "often")
    alike = Cut(filed.df.join(often.df, "key"), "alike")
    filed.drop()
    often.drop()
    stretches = Cut(alike.df.groupBy("key", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("did", "start", "windows")).alias("one")), "stretches")
    settled = alike.df.join(stretches.df.filter("n > 1").select("key", "stretch"), ["key", "stretch"]).select("did", "start", "windows")
    # where a key has several stretches and some are met once, their windows may still be repeated
    unsure = Cut(stretches.df.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("key"), "unsure")
    asked = cut(stretches.df.join(unsure.df, "key").select("one.*").groupBy("did").agg(F.collect_list(F.struct("start", "windows")).alias("spans")), "asked")
    once = only_ids(text.select("did", "text"), asked.select("did"), "did").dropDuplicates(["did"])
    single = Cut(once.join(asked, "did").select("did", "text", "spans").mapInArrow(_windows(window), "h1 long, h2 long, did long, start int"), "windows")
    again = Cut(single.df.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "again")
    found = settled.unionByName(single.df.join(again.df, ["h1", "h2"]).select("did", "start", F.lit(1).alias("windows")))
    out = cut(found.groupBy("did").agg(F.collect_list(F.struct("start", "windows")).alias("spans")), "repeated")
    for x in (alike, stretches, unsure, single, again):
        x.drop()
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_words, n_removed, kept): texts without any word that a repeated window covers.

    Windows are judged on the input. kept has one space between words. Null
    and wordless texts have no words and keep the empty text; those of fewer
    words than a window lose none; rows that repeat are documents of their
    own, and so lose all words if they have a window. An empty table gives
    none. Other columns aren't read.
    """
    text, _ = _identity(docs)
    spans = repeated(text, window)
    ids = spans.select("did")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    none: Column = F.lit(None).cast("array<struct<start: int, windows: int>>")
    hit = only_ids(text, ids, "did").join(spans, "did").select("doc_id", "text", "spans").mapInArrow(_kept(window), schema)
    rest = only_ids(text, ids, "did", keep=False).select("doc_id", "text", none.alias("spans")).mapInArrow(_kept(window), schema)
    return hit.unionByName(rest)
