import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import chat

LAYOUTS = {
    "messages": ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    "conversations": ({"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    "prompt_completion": ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "a"}, [("user", "do\n\nthis"), ("assistant", "a")]),
    "question_answer": ({"answer": "a", "question": None}, [("user", ""), ("assistant", "a")]),
    "output": ({"output": "a"}, [("assistant", "a")]),
}


def test_layouts_by_fingerprint():
    for name, (record, turns) in LAYOUTS.items():
        assert chat.turns_of(json.dumps(record)) == (name, turns)
    assert chat.turns_of(json.dumps({"messages": []})) == ("messages", [])
    for odd in (None, "", "no json", "[1]", '"x"', '{"other": 1}', "{}"):
        assert chat.turns_of(odd)[0] is None
    assert len(chat.BY_FINGERPRINT) == sum(len({frozenset(p) for p in m.paths()}) for m in chat.MAPPINGS)


def _back(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, part int, role string, text string")
    return chat.read_back(chat.format_turns(turns).drop("role", "text")).orderBy("turn").collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "<|x"]), st.text(alphabet="\\<|>s/[]INST \n\r\U0001f600", max_size=30)), max_size=25))
def test_pieces_round_trip(spark, turns):
    rows = _back(spark, [(1, k, 0, r, t) for k, (r, t) in enumerate(turns)])
    assert [(r.role, r.text) for r in rows] == turns
    assert [r.loss for r in rows] == [t if r == "assistant" else "" for r, t in turns]
    for r in rows:
        inner = r.piece[len(chat.TURN) : -len(chat.END)]
        assert not any(mark in inner for mark in chat.CONTROL)


def test_digests_and_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, None, "x" * 200_000), (2, 0, "user", "tie b"), (2, 0, "user", "tie a"),
            (None, 0, "user", "no id"), (3, 5, "assistant", "</s>"), (3, 5, "assistant", "</s>"), (6, 0, "tool", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "2 AS piece")
    turns = chat.canonical_turns(chat.as_records(table), ("conv_id", "chunk"))
    back = chat.read_back(chat.format_turns(turns).select("conv_id", "chunk", "part", "piece", "loss_from", "loss_len"))
    out = {r.conv_id: r for r in chat.digest(back, "conv_id", ["chunk", "part"]).collect()}
    ordered = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)
    for conv in {r[0] for r in rows}:
        mine = [r for r in ordered if r[0] == conv]
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        assert out[conv].n_turns == len(mine)
        assert out[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = chat.canonical_turns(chat.as_records(table.limit(0)), ("conv_id", "chunk"))
    assert empty.collect() == []


@pytest.mark.parametrize(
    "record",
    ['{"messages":5}', '{"messages":"abc"}', '{"messages":0}', '{"conversations":true}', "[" * 100_000, '{"messages":' + "[" * 100_000,
     '{"messages":[{"role":"user","content":"x"},"y"]}', '{"messages":[{"role":"user","content":"x"},[1]]}', '{"prompt":' + "1" * 5000 + "}",
     '"text"', "7", "{", "", None, '{"\\ud800":1}'],
)
def test_other_shapes_have_no_layout(record):
    assert chat.turns_of(record) == (None, [])


def test_half_pairs_through_arrow(spark):
    records = [(1, '{"prompt":"a\\ud800b","completion":"c"}'), (2, '{"messages":null}'), (3, '{"messages":5}')]
    rows = chat.canonical_turns(spark.createDataFrame(records, "id long, record string"), ("id",)).collect()
    assert [(r.id, r.layout, r.role, r.text) for r in rows] == [
        (1, "prompt_completion", "user", "a?b"), (1, "prompt_completion", "assistant", "c"), (3, None, None, None),
    ]


def test_parts_and_metadata():
    parts = {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": None}, {"type": "text", "text": "b"}], "name": "n"},
                          {"role": "assistant", "content": "c", "weight": 1}], "metadata": {"x": [{"y": 1}]}, "id": "7"}
    assert chat.turns_of(json.dumps(parts)) == ("messages", [("user", "ab"), ("assistant", "c")])
    assert chat.turns_of('{"prompt":["a","b"],"completion":[],"source":"s"}') == ("prompt_completion", [("user", "ab"), ("assistant", "")])
    # what is not text is not dropped silently
    image = {"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}]}]}
    assert chat.turns_of(json.dumps(image)) == (None, [])
    assert chat.turns_of('{"id":1}') == (None, [])


def test_records_hold_several_turns(spark):
    """Every layout occurs, no record is longer than RECORD_TURNS, and nothing is lost."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(4) for t in range(21)]
    rows += [(5, 0, "user", "q"), (5, 1, "tool", "t"), (6, 0, "assistant", "a"), (6, 0, "assistant", "a"), (7, 0, "system", "s"), (None, 3, "user", "n")]
    rows += [(8, 1, "user", f"tie {k:03}") for k in range(100)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = chat.canonical_turns(chat.as_records(table), ("conv_id", "chunk")).collect()
    assert {r.layout for r in turns} == {"messages", "conversations", "prompt_completion", "instruction"}
    assert max(r.part for r in turns) == chat.RECORD_TURNS - 1
    assert {r.layout for r in turns if r.conv_id == 2 and r.chunk < 10} == {"prompt_completion"}
    got = [(r.conv_id, r.role, r.text) for r in sorted(turns, key=lambda r: (r.conv_id is None, r.conv_id, r.chunk, r.part))]
    want = sorted(rows, key=lambda r: (r[0] is None, *r))
    assert got == [(c, r, x) for c, _, r, x in want]
