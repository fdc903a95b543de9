"""SimHash near-duplicates, found through Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two differ
in at most two bits, one segment is equal and a second one, of 23 bits, differs
in at most two. Each 23-bit word has one codeword of the perfect binary Golay
code within distance 3; words within distance 2 share a codeword within
distance 4 (of the word halfway, the nearest one). So a key is an equal
segment with a nearby codeword's index: one or six for each partner segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantables.llm.common import Cut, cut, fresh, only_ids
from plantables.llm.components import components

#: Generator polynomial of the binary Golay code, and the cut of a fingerprint (shift, bits).
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: (equal segment, segment whose errors the code takes up)
TABLES = ((0, 1), (1, 0), (2, 0))
#: Buckets of more fingerprints than this go through shared one-bit neighbours, not pairs.
FULL_BUCKET = 16
SHINGLE = 3
SEED = 42
#: Shingle hashes whose bits are spread out at a time.
SLAB = 1 << 17


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLAB):
        bits = np.unpackbits(hashes[i : i + SLAB].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """documents -> (doc_id, which, fp): one row for each row; which is xxhash64 of the text; other columns aren't read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).view(pa.binary()) if b.column(2).type == pa.string() else b.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(x.as_py(), width) for x in texts], pa.int64())], ["doc_id", "which", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("which"), text.alias("text")).mapInArrow(scan, "doc_id long, which long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator, of words of 23 bits."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << bit - 11, rest)
    return rest


@cache
def _errors() -> np.ndarray:
    """By syndrome: the error to the nearest codeword, then those of weight 4 (the first again where there are none)."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)])
        for s, e in zip(_syndrome(patterns), patterns, strict=True):
            if weight < 4 or found[s][0].bit_count() == 3:
                found[s].append(int(e))
    return np.array([(x + x[:1] * 6)[:6] for x in found], np.int64)


def golay_keys(words: np.ndarray) -> np.ndarray:
    """n words of up to 23 bits -> (n, 6) indices of the codewords within distance 4, repeats where there are fewer."""
    return (words[:, None] ^ _errors()[_syndrome(words)]) >> 11


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in fps, key), each once."""
    bits = fps.view(np.uint64)
    part = [(bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for t, (equal, near) in enumerate(TABLES):
        index = np.sort(golay_keys(part[near]), axis=1)
        fresh = np.ones(index.shape, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        rows.append(row)
        keys.append(t << 40 | part[equal][row] << 12 | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        row, key = _keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.array(key)], ["fp", "key"])


def _differ(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, full: int = FULL_BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that give the components of "2 or fewer bits differ".

    Buckets of up to `full` are joined and verified pair by pair. Fingerprints
    of a fuller bucket are grouped by each word within one bit of them: two
    that share such a word differ in two bits at most, and any two that do
    share one, so a star to the smallest of the group loses no link.
    """
    keyed = fps.mapInArrow(_with_keys, "fp long, key long")
    held = Cut(keyed, "golay")
    sizes = held.df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    busy = Cut(held.df.join(sizes, "key"), "buckets")
    few = busy.df.filter(F.col("n") <= full).select("key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").filter("a > b").filter(_differ("a", "b") <= 2).select("a", "b").distinct()
    )
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spread = busy.df.filter(F.col("n") > full).select("fp").distinct().select("fp", F.explode(around).alias("word"))
    least = spread.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("word", "b")
    stars = spread.join(least, "word").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    out = cut(pairs.unionByName(stars), "links")
    held.drop()
    busy.drop()
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, which, fp, head, component_id), one row for each row.

    Fingerprints are grouped first, so a thousand copies are one fingerprint
    in the search. component_id is the smallest doc_id reachable over links of
    2 or fewer differing bits, head the smallest (doc_id, which) of rows with
    an id. Null and wordless texts have fingerprint 0 and
    link like others; repeated rows share a component; a null doc_id takes
    its component's smallest id, null if there is none. An empty table gives
    none. Columns besides doc_id and text are left out.
    """
    marked = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(heads(marked), "classes")
    return spread_labels(marked, classes, components(links(classes.select("fp"))))


def heads(marked: DataFrame) -> DataFrame:
    """(doc_id, which, fp) -> (fp, least): the smallest (doc_id, which) of a fingerprint's rows that have an id."""
    return marked.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "which"))).alias("least"))


def spread_labels(marked: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, which, fp), (fp, least) and components (node, label) of fp -> (doc_id, which, fp, head, component_id)."""
    joined = classes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("least").alias("head"))
    of = joined.select("fp", "label").join(least, "label").select("fp", "head")
    return marked.join(of, "fp").select("doc_id", "which", "fp", "head", F.col("head.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id stays, once.

    Rows are told by id and hash of the text, so that of two unlike texts
    under one id none is lost; of like ones the smaller hash stays. Rows that
    go are fewer than those that stay, so documents are told by them. Rows
    that repeat a kept id and text are cut to one; only those are moved for
    it. Rows without an id stay, as none of them can be named. Columns are
    those given, whatever their names.
    """
    return keep_least(docs, near_duplicates(docs, width))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one by components (doc_id, which, head) found already."""
    key = fresh(docs, "__id", "__which")
    found = found.filter("doc_id is not null").select(F.col("doc_id").alias(key[0]), F.col("which").alias(key[1]), (F.struct("doc_id", "which") == F.col("head")).alias("stays"))
    ids = cut(found.groupBy(*key).agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1"), "copies")
    named = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: F.xxhash64(F.col("text").cast("string"))})
    once = only_ids(named, ids.select(*key), key, keep=False).drop(*key)
    again = ids.filter("stays").select(*key)
    if again.isEmpty():
        return once
    (row,) = fresh(docs, "__row")
    all_of = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = only_ids(named, again, key).groupBy(*key).agg(F.min_by(all_of, F.xxhash64(all_of)).alias(row))
    return once.unionByName(one.select(f"{row}.*"))
