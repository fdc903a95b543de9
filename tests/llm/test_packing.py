import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantables.llm import packing
from tests.llm.test_records import TEXTS as ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [*ODD, "Don't WE'LL", "É é ﬁ İ ẞ ǰ J̌ Σας", "a<|ENDOFTEXT|>b <|startoftext|>x", "x1y22 3,4", "</w> a</w>b", " ", "\x1c \x85\xa0", "..." * 50, "Word, word. WORD!?", "ａｂ 漢字 漢字", "🙂🙂 a🙂", "größe$$$ a|> é*** x_ y__. 'tis l'' O'", "e\u0301. E\u0301, क़."]


WHOLE, ENCODER = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)


def ids_of(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [5, packing.KEPT_CHUNKS])
def test_chunks_encode_as_the_whole_text(monkeypatch, kept):
    monkeypatch.setattr(packing, "KEPT_CHUNKS", kept)
    encoder = packing.WordEncoder(PATH)
    wanted = [ids_of(t) for t in TEXTS]
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode(pa.array(TEXTS))] == wanted
        for t, w in zip(TEXTS, wanted, strict=True):
            assert encoder.encode(pa.array([t]))[0].tolist() == w, repr(t)
    assert encoder.encode(pa.array([], pa.string())) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZ é'.,$_1 \n\t\u0301́\x85İJ̌<|>endoftxsr_", max_size=40), min_size=1, max_size=5))
def test_any_text_encodes_as_the_library_does(texts):
    assert [x.tolist() for x in ENCODER.encode(pa.array(texts))] == [ids_of(t) for t in texts]


def bins_of(counts, made):
    """The plan, slot by slot: sequence -> [(offset, length)]."""
    out = {}
    for i in range(len(made.length)):
        size = int(made.length[i])
        last = int(made.number[i + 1]) if i + 1 < len(made.length) and made.length[i + 1] == size else counts[size]
        for j in range(last - int(made.number[i])):
            s = int(made.first[i]) + j // int(made.copies[i])
            out.setdefault(s, []).append((int(made.offset[i]) + j % int(made.copies[i]) * size, size))
    return out


def check(counts, capacity):
    made = packing.plan(counts, capacity)
    bins = bins_of(counts, made)
    assert sorted(bins) == list(range(made.n))
    got = {}
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
            got[size] = got.get(size, 0) + 1
        assert at <= capacity
    assert got == {s: n for s, n in counts.items() if n}
    return made.n


def fewest(sizes, capacity):
    """Fewest bins, by trying all."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_plan_is_close_to_the_fewest_sequences():
    over = 0
    for seed in range(40):
        r = random.Random(seed)
        sizes = sorted((r.randint(1, 30) for _ in range(8)), reverse=True)
        n = check({s: sizes.count(s) for s in sizes}, 30)
        least = fewest(sizes, 30)
        assert least <= n <= least + 1
        over += n - least
    assert over <= 3


def test_two_replace_the_smallest():
    # greedy takes 6 + 3 and leaves 1; 2 + 2 fit the room of 4 more tightly
    made = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(sorted(s for _, s in b) for b in bins_of({6: 1, 3: 1, 2: 2}, made).values()) == [[2, 2, 6], [3]]
    assert packing.plan({6: 2, 4: 0, 3: 2, 2: 4}, 10).n == 3


def test_plan_of_many_repeats_bins_and_is_small():
    r = random.Random(1)
    counts = {s: r.randint(1, 10**9) for s in range(1, 4097)}
    made = packing.plan(counts)
    total = sum(s * n for s, n in counts.items())
    assert -(-total // 4096) <= made.n <= total / 4096 * 1.004 + 1  # half of them are longer than half a sequence: no plan reaches the sum
    assert len(made.length) < 100_000
    counts = {s: r.randint(0, 20) for s in range(1, 4097)}
    n = check(counts, 4096)
    assert n <= sum(s * k for s, k in counts.items()) / 4096 * 1.01 + 1
    assert packing.plan({}).n == 0 and packing.plan({4096: 7}).n == 7


def test_pieces_tile_sequences(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, None, None, None), (None, "a b", "y", 2), (900, "one two " * 5000, "y", 2), (901, "w " * 4095, "", 3), (902, "w " * 4096, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    packed = packing.pack(docs, PATH, keep_ids=True)
    got = packed.collect()
    assert packed.columns == ["length", "doc_id", "piece", "start", "ids_crc32", "ids", "sequence_id", "offset"]
    wanted = {}
    for i, t, *_ in rows:
        ids = [*ids_of(t or ""), 1]
        for k in range(0, len(ids), 4096):
            key = (i, k // 4096, k, tuple(ids[k : k + 4096]))
            wanted[key] = wanted.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, tuple(r.ids))
        found[key] = found.get(key, 0) + 1
        assert (r.length, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    assert found == wanted
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, list(r.ids)))
    for some in held.values():
        at = 0
        for offset, length, _ in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(r.length for r in got) // 4096)
    for r in packing.sequences(packed).collect():
        assert r.ids == list(itertools.chain.from_iterable(x for _, _, x in sorted(held[r.sequence_id]))) and sum(r.lengths) == len(r.ids)
    assert packing.pack(docs.limit(0), PATH).count() == 0
