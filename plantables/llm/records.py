"""Token ids in length-delimited binary record files with a separate offset index.

A record is: length (8 bytes, little-endian), masked CRC of those, the data,
masked CRC of the data. Data is the ids of one document, in 2 bytes each where
the vocabulary allows and else 4, little-endian. Files hold whole documents in
ascending doc_id order, file after file; the index has a row for each record
(file, offset, ids before it), so that any record is read without the others.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantables.llm.common import cut, new_path

END_ID = 2
#: Encoded chunks a worker keeps, twice: a full store becomes the older one, from which what is met again is taken.
KEPT_CHUNKS = 700_000
#: Texts encoded together.
GROUP = 1024
#: Bytes of text for each range of documents, and so for each file; and ranges at most.
FILE_BYTES, MOST_RANGES = 32 << 20, 1 << 16

INDEX = "file_no int, file string, record long, offset long, n_bytes long, doc_id long, n_tokens long"


def masked(crc: int) -> int:
    """A checksum that may itself be stored among checked data: rotated by 15 bits, plus a constant."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), data, struct.pack("<I", masked(zlib.crc32(data)))))


def unframe(f, where: str) -> bytes:
    """The next record's data; ValueError if it is cut off or doesn't match its checksums."""
    head = f.read(12)
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"{where}: broken record length")
    n = struct.unpack("<Q", head[:8])[0]
    data, crc = f.read(n), f.read(4)
    if len(data) < n or len(crc) < 4 or masked(zlib.crc32(data)) != struct.unpack("<I", crc)[0]:
        raise ValueError(f"{where}: broken record data")
    return data


class Encoder:
    """Ids of whole texts by the tokenizers library, each chunk encoded once while it is kept.

    This byte-level pre-tokenizer never joins what stands before white space
    with it, so a text may be cut before a space or a line's end that follows
    a non-space. Chunks not met before go to the library together, as one
    text; each starts with a space (or a line's end), and only there does an
    id stand whose bytes begin with one. A chunk's space isn't part of its key.
    A text that holds the string of an added token goes to the library whole,
    as that string may be one id, whatever stands around it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.lines = np.zeros_like(self.opens)
        self.lines[[i for t, i in vocab.items() if t.startswith("Ċ")]] = True
        self.kept: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}
        self.marks: dict[str, bytes] = {}  # what has no space before it: marks after words, and texts' starts

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pack(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Fills kept: False for a chunk that white space begins or ends, which can't stand alone."""
        ends: dict[str, str] = {}
        alone: set[str] = set()
        for c in chunks:
            if c[:1] == "\n" and len(c) > 1 and not c[1].isspace() and not c[-1].isspace() or c and not c[0].isspace() and not c[-1].isspace():
                stem = c.rstrip(string.punctuation)
                if len(stem) < len(c) and stem.lstrip("\n").isalpha():  # letters, then marks: the pre-tokenizer cuts between
                    ends[c] = stem
                    if self._known(stem) is None:
                        alone.add(stem)
                else:
                    alone.add(c)
            else:
                self.kept[c] = False
        for line in (False, True):
            todo = [c for c in alone if (c[0] == "\n") == line]
            starts, before = (self.lines, "") if line else (self.opens, " ")
            for i in range(0, len(todo), 4096):
                some = todo[i : i + 4096]
                ids = np.array(self._ids("".join([f"{before}{c}" for c in some])), np.int64)
                at = np.flatnonzero(starts[ids])
                if len(at) != len(some):  # not so for this vocabulary: one by one
                    self.kept.update((c, self._pack(f"{before}{c}")) for c in some)
                    continue
                packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
                edges = [*(at * width).tolist(), len(packed)]
                self.kept.update(zip(some, map(packed.__getitem__, map(slice, edges, edges[1:])), strict=True))
        for c, stem in ends.items():
            marks = c[len(stem) :]
            if marks not in self.marks:
                self.marks[marks] = self._pack(marks)
            self.kept[c] = self.kept[stem] + self.marks[marks]

    def _holds_added(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for token in self.added:
            # white space in a token could stand between two chunks
            found |= any(map(str.isspace, token)) or pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    def _known(self, chunk: str) -> bytes | bool | None:
        """From the kept ones, or from those kept before them."""
        if chunk not in self.kept and chunk in self.older:
            self.kept[chunk] = self.older[chunk]
        return self.kept.get(chunk)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed ids of each text; none is null.

        Distinct chunks of all texts are looked up once, and ids gathered by
        their numbers.
        """
        if max(len(self.kept), len(self.marks)) > KEPT_CHUNKS:
            self.older, self.kept, self.marks = self.kept, {}, {}
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        whole = self._holds_added(texts)
        if whole.any():
            rest = iter(self.encode(texts.filter(pa.array(~whole))))
            return [self._pack(t.as_py()) if w else next(rest) for t, w in zip(texts, whole, strict=True)]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        number, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        got = list(map(self.kept.get, chunks))
        if None in got:
            new = {c for c, x in zip(chunks, got, strict=True) if x is None}
            old = new.intersection(self.older)
            self.kept.update((c, self.older[c]) for c in old)
            new -= old
            if new:
                self._learn(new)
            got = list(map(self.kept.__getitem__, chunks))
        width = self.dtype.itemsize
        odd = np.fromiter((x is False for x in got), bool, len(got))
        size = np.fromiter((len(x or b"") for x in got), np.int64, len(got)) // width
        ids = np.frombuffer(b"".join([x or b"" for x in got]), self.dtype)
        begin = np.cumsum(size) - size
        n = size[number]
        n[first] = 0  # a text's start has no space before it: encoded below
        after = np.cumsum(n)
        flat = ids[np.repeat(begin[number] - after + n, n) + np.arange(after[-1])].tobytes()
        uneven = odd[number]
        several = np.diff(np.append(first, len(number))) > 1
        uneven[first] &= several
        uneven = np.logical_or.reduceat(uneven, first)
        ends = after[np.append(first[1:], len(number)) - 1] * width
        out, at = [], 0
        for i, end in enumerate(ends.tolist()):
            if uneven[i]:
                out.append(self._uneven(texts[i].as_py().split(" ")))
            else:
                start = chunks[number[first[i]]]
                if start not in self.marks:
                    self.marks[start] = self._pack(start)
                out.append(self.marks[start] + flat[at:end])
            at = end
        return out

    def _uneven(self, chunks: list[str]) -> bytes:
        """Chunks of a text with uneven white space, put together again where it stands at a cut."""
        out = chunks[:1]
        for x in chunks[1:]:
            if not out[-1] or out[-1][-1].isspace() or not x or x[0].isspace():
                out[-1] = f"{out[-1]} {x}"
            else:
                out.append(x)
        return self._pack(out[0]) + b"".join(self._known(c) or self._pack(f" {c}") for c in out[1:])


def _encoder(path: str, held: dict[str, Encoder] = {}) -> Encoder:  # noqa: B006  kept by the worker on purpose
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """documents(doc_id, text) -> record files in folder, and their index as a table.

    Index: file_no, file, record, offset, n_bytes, doc_id, n_tokens. Null text
    is empty (the end id alone). Rows are ordered by doc_id, nulls first, then
    text; rows that repeat are written as often. An empty table writes no
    file. A task that is run again writes files of new names, and only those
    of the run that counted are in the index. A text of any length is one
    record. Other columns aren't read.

    Each range of ids holds about FILE_BYTES of text, by sums over many short
    ranges, and becomes a file; rows of one id stay together.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, no, out, at, record = _encoder(tokenizer), TaskContext.get().partitionId(), None, 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        name = f"ids-{no:06d}-{uuid.uuid4().hex}.rec"  # one partition, one range, one file
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            rows: list[tuple[int, int, int, int]] = []
            for i in range(0, b.num_rows, GROUP):
                for data in encoder.encode(pc.fill_null(b.column(1).slice(i, GROUP), "")):
                    whole = frame(data + end)
                    out.write(whole)
                    rows.append((record, at, len(whole), len(data) // encoder.dtype.itemsize + 1))
                    record, at = record + 1, at + len(whole)
            record_no, offset, size, tokens = zip(*rows, strict=True)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([no] * n, pa.int32()), pa.array([name] * n), pa.array(record_no, pa.int64()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), b.column(0), pa.array(tokens, pa.int64())],
                [x.split()[0] for x in INDEX.split(", ")],
            )
        if out is not None:
            out.close()

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    edges = _edges(text)
    index = text.repartitionById(len(edges) + 1, _number(edges)(F.col("doc_id"))).sortWithinPartitions("doc_id", "text").mapInArrow(put, INDEX)
    return cut(index, "index").withColumn("folder", F.lit(folder))


def _number(edges: np.ndarray):
    """doc_id -> how many edges are below it; 0 for null."""

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(edges, ids.fillna(0).astype(np.int64))).astype(np.int32))

    return number


def _edges(text: DataFrame) -> np.ndarray:
    """Ids at which ranges end, so that each has about FILE_BYTES, or its share of a smaller table.

    Sums go by up to MOST_RANGES short ranges of about as many rows each.
    """
    rows = text.count()
    if not rows:
        return np.zeros(0, np.int64)
    short = min(MOST_RANGES, max(256, rows // 64))
    found = text.agg(F.percentile_approx("doc_id", [k / short for k in range(1, short)], 4 * short)).first()[0] or []
    fine = np.unique(np.array(found, np.int64))
    held = text.groupBy(_number(fine)("doc_id").alias("k")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()
    sums = np.zeros(len(fine) + 1)
    for r in held:
        sums[r.k] = r.n
    ranges = max(text.sparkSession.sparkContext.defaultParallelism, int(sums.sum() // FILE_BYTES))
    at = np.minimum((np.cumsum(sums) - sums / 2) * ranges / max(1, sums.sum()), ranges - 1).astype(np.int64)
    return fine[np.flatnonzero(np.diff(at))]


def read(index: DataFrame, itemsize: int) -> DataFrame:
    """Records that an index lists -> (file_no, record, doc_id, n_tokens, ids_crc32), read from the files and checked.

    Index rows may be any subset in any order. ids_crc32 is of the ids as little-endian unsigned 32-bit numbers.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for b in batches:
            tokens, crcs = [], []
            for folder, file, offset in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                if name != (folder, file):
                    store, base = fs.FileSystem.from_uri(folder)
                    opened, name = store.open_input_file(f"{base}/{file}"), (folder, file)
                opened.seek(offset)
                ids = np.frombuffer(unframe(opened, f"{file} at {offset}"), f"<u{itemsize}").astype("<u4")
                tokens.append(len(ids))
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tokens, pa.int64()), pa.array(crcs, pa.int64())], ["file_no", "record", "doc_id", "n_tokens", "ids_crc32"])

    return index.select("file_no", "record", "doc_id", "folder", "file", "offset").mapInArrow(get, "file_no int, record long, doc_id long, n_tokens long, ids_crc32 long")


def token_starts(rows: DataFrame) -> DataFrame:
    """Rows with file_no, record and n_tokens, and `start`: ids of all records before, over all files.

    Sums by file are put in a row first; within a file the rows are its own.
    """
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("held"))
    before = files.select("file_no", (F.sum("held").over(Window.orderBy("file_no")) - F.col("held")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("record")) - F.col("n_tokens")
    return rows.join(before, "file_no").withColumn("start", F.col("before") + inside).drop("before")
