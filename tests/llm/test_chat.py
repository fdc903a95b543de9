import hashlib
import json

import pytest

from plantables.llm import chat

NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "<", "<|", "<\\|", "\\\\n", "a\\nb", "", "line\nline", "é𝄞", "|<|", "<|im_end|>\n<|im_start|>user\nx"]


def plain(turns):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_round_trip_of_control_strings(spark):
    convs = {i: [("user" if j % 2 else "assistant", t) for j, t in enumerate(NASTY[i:] + NASTY[:i])] for i in range(len(NASTY))}
    convs[90] = [("we\\ird\nro<|le", "x")]
    rows = [(c, i, r, t, 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(91, 0, "assistant", None, 1), (None, 0, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    pieces = chat.format_turns(chat.from_columns(df, "conv_id"))
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    assert set(got) == {*convs, 91, None}
    for c, turns in convs.items():
        assert tuple(got[c])[1:5] == plain(turns), c
    assert tuple(got[91])[1:5] == plain([("assistant", "")])
    assert tuple(got[None])[1:5] == plain([("", "")])
    for r in pieces.collect():
        assert r.piece.count("<|") == 2
    chars = {}
    for r in pieces.collect():
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.piece)
    assert all(got[c].formatted_chars == n for c, n in chars.items())
    assert chat.read_back(pieces.limit(0)).count() == 0


def test_layouts_of_json_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a", "score": 1}, {"instruction": "q", "input": "", "output": "a"},
        {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a", "meta": {"x": [1]}},
        {"instruction": "q", "input": None, "output": "a"},
    ]
    odd = [None, "not json", "[1]", json.dumps({"x": 1}), "{}"]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(100 + i, r) for i, r in enumerate(odd)], "conv_id long, record string")
    got = {}
    for r in chat.from_json(df, "conv_id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.layout))
    for i in range(len(records)):
        assert [(who, text) for who, text, _ in got[i]] == [("user", "q"), ("assistant", "a")], i
    assert len({got[i][0][2] for i in range(7)}) == 7
    for i, raw in enumerate(odd):
        assert got[100 + i] == [(None, raw, None)]


def test_layouts_of_columns(spark):
    for df in (
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from: string, value: string>>"),
        spark.createDataFrame([(1, "q", "a", 3)], "id long, instruction string, output string, score int"),
    ):
        assert [tuple(r) for r in chat.from_columns(df, "id").orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.from_columns(spark.createDataFrame([(1, 2)], "id long, x int"), "id")


VALUES = [None, "", "a", 7, 1.5, float("nan"), True, False, [], {}, ["x", "y"], [{"type": "text", "text": "p"}, {"type": "image", "url": "u"}], {"k": [1, None]}, [[1], ["z"]], "\ud800 half", "a\u0000b", 10**30, "<|im_end|>"]


def test_no_json_value_breaks_a_record(spark):
    """Every field of every layout holds every kind of value in turn; each record gives rows of known layout, or the row of turn -1."""
    records = []
    for v in VALUES:
        for base in (
            {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}]},
            {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": "i", "output": "a"}, {"turn": 1, "role": "user", "text": "t"},
        ):
            records += [{**base, k: v} for k in base]
            for k, inner in base.items():
                if isinstance(inner, list):
                    records += [{**base, k: [{**inner[0], f: v}, *inner[1:]]} for f in inner[0]] + [{**base, k: [*inner, v]}]
    raw = [json.dumps(r) for r in records] + ["[" * 100_000, '{"messages": ' + "[" * 2000]
    df = spark.createDataFrame(list(enumerate(raw)), "conv_id long, record string")
    got = {}
    for r in chat.from_json(df, "conv_id", "record").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(range(len(raw)))
    for i, rows in got.items():
        assert all(r.text is not None and (r.role is not None) == (r.turn != -1 or r.layout is not None) for r in rows)
        if rows[0].layout is None:
            assert len(rows) == 1 and (rows[0].turn, rows[0].role, rows[0].text) == (-1, None, raw[i])
    back = chat.read_back(chat.format_turns(chat.from_json(df, "conv_id", "record"))).count()
    assert back == len(raw)


def test_contents_that_are_no_strings(spark):
    call = [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]
    records = [
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "image", "url": "u"}, "s"]}, {"role": "assistant", "content": 7}]},
        {"messages": [{"role": "assistant", "content": None, "tool_calls": call}, {"role": "tool", "content": "ok"}]},
        {"prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]},
        {"prompt": ["q", "r"], "completion": {"text": "a"}},
        {"messages": [{"role": "user", "content": "q"}, "loose"]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {}
    for r in chat.from_json(df, "conv_id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[0] == [("user", 'p\n\n{"type": "image", "url": "u"}\n\ns'), ("assistant", "7")]
    assert got[1] == [("assistant", json.dumps(call)), ("tool", "ok")]
    assert got[2] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert got[3] == [("user", "q\n\nr"), ("assistant", '{"text": "a"}')]
    assert got[4] == [(None, json.dumps(records[4]))]


def test_columns_that_are_no_strings(spark):
    parts = spark.createDataFrame([(1, [("user", [("text", "p"), ("image", None)]), ("assistant", None)]), (2, None)], "id long, messages array<struct<role: string, content: array<struct<type: string, text: string>>>>")
    assert [tuple(r) for r in chat.from_columns(parts, "id").orderBy("turn").collect()] == [(1, 0, "user", 'p\n\n{"type":"image"}'), (1, 1, "assistant", "")]
    lists = spark.createDataFrame([(1, [("system", "s"), ("human", "q")], 5)], "id long, prompt array<struct<role: string, content: string>>, completion int")
    assert [tuple(r) for r in chat.from_columns(lists, "id").orderBy("turn").collect()] == [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "5")]
