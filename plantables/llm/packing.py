"""Packing of tokenized documents into sequences of one size by best-two-fit.

A document longer than a sequence is cut into whole sequences and a rest.
What can be packed depends on lengths only, of which there are no more than a
sequence has tokens. So the plan is made from the counts of lengths: a bin is
filled greedily, largest first; its smallest piece is replaced by the two
unpacked ones that fill its expanded gap best, if they fill it more tightly;
and the bin is repeated as often as the counts last. The plan's size is bound
by the number of lengths, whatever the number of documents. Pieces of a length
are numbered over the whole table, and a piece's number names its bin.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.llm.common import cut

#: Tokens of a sequence, and the id after each document.
CAPACITY, END_ID = 4096, 1
#: Chunks of text between spaces that a worker keeps encoded, twice (the older ones are taken from until as many new ones are met); texts encoded together.
KEPT_CHUNKS, GROUP = 500_000, 512


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space and never joins across it: each distinct chunk between spaces is encoded once while it is kept.

    White space other than spaces and line ends stays inside chunks and is
    the library's matter, as is all but words of letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        largest = max(vocab.values(), default=0)
        self.dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.ends = np.zeros(largest + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> None:
        """Keeps words of letters, encoded as one text: each ends with an id that ends a word, mostly the only one in it."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):  # some word isn't one piece
                self._others(some)
                continue
            packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            edges = [0, *((last + 1) * width).tolist()]
            self.kept.update(zip(some, map(packed.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def _others(self, chunks: list[str]) -> None:
        self.kept.update((c, self._pack(e.ids)) for c, e in zip(chunks, self.library.encode_batch_fast(chunks, add_special_tokens=False), strict=True))

    def _find(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        got = list(map(self.kept.get, chunks))
        new = [c for c, x in zip(chunks, got, strict=True) if x is None]
        if new:
            self.kept.update((c, self.older[c]) for c in new if c in self.older)
            new = [c for c in new if c not in self.kept]
            self._words([c for c in new if c.isalpha()])
            if others := [c for c in new if not c.isalpha()]:
                self._others(others)
            got = list(map(self.kept.__getitem__, chunks))
        return got

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty.

        A to Z are lowered before texts are cut, but for texts where they
        stand before a combining mark (the library joins both first) or where
        an added token may be. Marks that end a chunk after a letter are
        chunks of their own, but for those that an added token has.
        """
        if not len(texts):
            return []
        if len(self.kept) > KEPT_CHUNKS:
            self.older, self.kept = self.kept, {}
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        texts = pc.if_else(pc.match_substring_regex(texts, r"[A-Z]\pM|<\|"), texts, pc.ascii_lower(texts))
        split = pc.split_pattern(pc.replace_substring_regex(texts, r"([a-zß-öø-ÿ])([!-/:;=?@\[-`{}~]+)( |$)", r"\1 \2\3"), " ")
        coded = split.flatten().dictionary_encode()
        number, got = coded.indices.to_numpy(), self._find(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(map(got.__getitem__, number.tolist())), self.dtype)
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()  # a text has one chunk at least
        return np.split(flat, np.cumsum(np.add.reduceat(size[number], first))[:-1])


def encoder_of(path: str, held: dict[str, WordEncoder] = {}) -> WordEncoder:  # noqa: B006  kept by the worker on purpose
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, part, nth), and ids if asked.

    A document's ids and one end id are cut into pieces of at most capacity.
    nth is a piece's number among those of its length in its task's part.
    Null text is empty (one end id); ids may be null or repeat, each row is a
    document; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = encoder_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                b = whole.slice(at, GROUP)
                row, number, start, length, crc, held = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(b.column(1).cast(pa.string()))):
                    wide = np.append(ids, np.array([end_id], ids.dtype)).astype("<u4")
                    for k, first in enumerate(range(0, len(wide), capacity)):
                        some = wide[first : first + capacity].tobytes()
                        row.append(i), number.append(k), start.append(first), length.append(len(some) // 4), crc.append(zlib.crc32(some))
                        if keep_ids:
                            held.append(some)
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                sizes, first, n = np.unique(size[order], return_index=True, return_counts=True)
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.repeat(first, n) + met[size[order]]
                met[sizes] += n
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if keep_ids:
                    ends = np.append(0, np.cumsum(size)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


@dataclass
class Plan:
    """Slots: pieces of a length, from a number on, go to bins from first on, so many copies in each, from offset on. n sequences."""

    length: np.ndarray
    number: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    n: int


def _fill(use: dict[int, int], left: np.ndarray, gap: int) -> int:
    """Puts the largest unpacked pieces that fit into a bin, one length after the other, and returns the gap that stays."""
    have = np.flatnonzero(left[: gap + 1]).tolist()
    i = len(have) - 1
    while i >= 0:
        size = have[i]
        n = min(int(left[size]), gap // size)
        if n:
            use[size] = use.get(size, 0) + n
            left[size] -= n
            gap -= n * size
        i = min(i, bisect_right(have, gap)) - 1
    return gap


def _best_two(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked pieces that fill a room best, the larger first."""
    have = np.flatnonzero(left[:room])
    if not len(have):
        return None
    at = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    at[(at == np.arange(len(have))) & (left[have] < 2)] -= 1
    total = np.where(at >= 0, have + have[at], 0)
    best = int(total.argmax())
    return (int(have[best]), int(have[at[best]])) if total[best] else None


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    """Numbers of pieces by length, 1 to capacity -> where each goes."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    number = np.zeros(capacity + 1, np.int64)
    slots, n_bins = [], 0
    while left.any():
        use: dict[int, int] = {}
        gap = _fill(use, left, capacity)
        smallest = min(use)
        if gap and (two := _best_two(left, smallest + gap)) and sum(two) > smallest:
            for size, n in ((smallest, -1), (two[0], 1), (two[1], 1)):
                use[size] = use.get(size, 0) + n
                left[size] -= n
            gap = _fill(use, left, smallest + gap - sum(two))
        more = min(int(left[size]) // n for size, n in use.items() if n)  # bins beside this one
        offset = 0
        for size in sorted((s for s, n in use.items() if n), reverse=True):
            n = use[size]
            slots.append((size, number[size], n, n_bins, offset))
            number[size] += n * (more + 1)
            left[size] -= n * more
            offset += n * size
        n_bins += more + 1
    slots.sort()
    return Plan(*np.array(slots, np.int64).reshape(-1, 5).T.copy(), n=n_bins)


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(), written -> the same rows with sequence_id and offset in place of part and nth.

    Pieces of a length are numbered over all parts: those of earlier parts
    come first. Counts by part and length are all that is shuffled but for
    one join on both.
    """
    spark = cut_pieces.sparkSession
    counts = cut(cut_pieces.groupBy("part", "length").count(), "lengths")
    made = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = cut_pieces.join(base, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    sent = spark.sparkContext.broadcast(made)  # a few slots for each length up to capacity

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = sent.value
        keys = p.length << 48 | p.number
        for b in batches:
            size, number = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(keys, size << 48 | number, side="right") - 1
            among = number - p.number[at]
            copies = p.copies[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.first[at] + among // copies), pa.array(p.offset[at] + among % copies * size)], [*b.schema.names, "sequence_id", "offset"])

    kept = [c for c in cut_pieces.columns if c not in ("length", "part", "nth")]
    types = {f.name: f.dataType.simpleString() for f in cut_pieces.schema.fields}
    schema = ", ".join(["length long", "number long", *(f"{c} {types[c]}" for c in kept), "sequence_id long", "offset long"])
    return numbered.select("length", "number", *kept).mapInArrow(slot, schema).drop("number")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ids if asked; a row for each piece."""
    return place(cut(pieces(docs, path, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """pack(keep_ids=True) -> (sequence_id, ids, lengths): the token sequences, and the lengths of the pieces in them. A sequence is no longer than its capacity."""
    parts: Column = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"))
