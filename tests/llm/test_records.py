import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantables.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>\n<|endof", "<|endoftext |>",  "", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b c", "a b  c d", "don't we'll  x", "　 x y", "x  y", "Größe 12,5 % <|endoftext|> end", "tab\t tab", "é́ ñ  ", "word " * 5000, "  lead two", "end  ", "\r\n \r\n", "a\x1c b", "a\x85 b", "it's, its' wait... wait? 's '' _x_ x²! Ⅷ. ok!\n ok! \n"]


def test_chunks_encode_as_the_whole_text(monkeypatch):
    whole = Tokenizer.from_file(PATH)
    monkeypatch.setattr(records, "KEPT_CHUNKS", 20)
    encoder = records.Encoder(PATH)
    for _ in range(4):
        for text in TEXTS:
            assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text[:40])
        for text, data in zip(TEXTS, encoder.encode(TEXTS), strict=True):
            assert np.frombuffer(data, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_frames_are_checked():
    data = records.frame(b"abc")
    assert records.unframe(io.BytesIO(data), "x") == b"abc"
    for i in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]), "x")
    with pytest.raises(ValueError):
        records.unframe(io.BytesIO(data[:-1]), "x")


def test_files_round_trip(spark):
    docs = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[1], 1), (None, None, 1)], "doc_id long, text string, n_tokens int")
    index = records.write(docs, PATH)
    listed = {(r.file_no, r.record): r for r in index.collect()}
    rows = sorted(records.token_starts(records.read(index, 2)).collect(), key=lambda r: (r.file_no, r.record))
    assert [r.doc_id for r in rows] == [None, *sorted([i * 3 for i in range(len(TEXTS))] + [3])]
    whole, at = Tokenizer.from_file(PATH), 0
    for r in rows:
        ids = [*whole.encode("" if r.doc_id is None else TEXTS[r.doc_id // 3], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, listed[r.file_no, r.record].n_tokens, r.ids_crc32) == (at, len(ids), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert records.read(records.write(docs.limit(0), PATH), 2).count() == 0


def test_ranges_are_even_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 20_000)
    rows = [(i, "x" * (2000 if i < 100 else 20)) for i in range(3000)] + [(None, "y"), (50, "z"), (2**62, "w")]
    text = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    edges = records._edges(text)
    held = {}
    for i, t in rows:
        k = 0 if i is None else int(np.searchsorted(edges, i))
        held[k] = held.get(k, 0) + len(t)
    assert len(held) == len(edges) + 1 >= 10 and max(held.values()) < 50_000
    index = records.write(text, PATH)
    back = sorted(records.read(index, 2).collect(), key=lambda r: (r.file_no, r.record))
    assert [r.doc_id for r in back] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert index.select("file_no").distinct().count() == len(held)
    assert len(records._edges(text.limit(0))) == len(records._edges(text.filter("doc_id is null"))) == 0
