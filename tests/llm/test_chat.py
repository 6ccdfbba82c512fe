"""Chat formatting: layouts, the template's round trip, and the loss mask."""

import hashlib
import json
import random

import pytest

from tessera.llm import chat


def frame(spark, rows):
    return spark.createDataFrame([(i, r, "clash") for i, r in rows], "conv_id long, record string, place string")


def got(df):
    return sorted(((r.id, r.place, r.role, r.text) for r in chat.turns(df).collect()), key=str)


def test_layouts_become_the_same_turns(spark):
    ways = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "source": "x"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"response": "a", "id": {"prompt": 3}, "prompt": "q"},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
    ]
    df = frame(spark, [(k, json.dumps(w)) for k, w in enumerate(ways)])
    assert got(df) == sorted(((k, p, r, t) for k in range(len(ways)) for p, r, t in ((0, "user", "q"), (1, "assistant", "a"))), key=str)
    other = frame(spark, [(1, json.dumps({"system": "s", "instruction": "q", "input": "i", "output": None})), (2, json.dumps({"turn": 4, "role": None, "text": None})), (3, json.dumps({"turn": None, "role": "gpt", "text": "x"}))])
    assert got(other) == sorted([(1, 0, "system", "s"), (1, 1, "user", "q\n\ni"), (1, 2, "assistant", ""), (2, 4, "", ""), (3, None, "gpt", "x")], key=str)


def test_unknown_layouts_are_counted(spark):
    df = frame(spark, [(1, None), (2, "[1]"), (3, "{"), (4, '{"a": 1}'), (5, '{"prompt": "q"}'), (6, '{"messages": []}'), (7, '{"prompt": 1, "response": 2}')])
    assert got(df) == [(7, 0, "user", "1"), (7, 1, "assistant", "2")]
    counted = {(r.layout, r.fingerprint is None): 0 for r in chat.layouts(df).collect()}
    assert sum(r.n for r in chat.layouts(df).collect()) == 7 and ("prompt", False) in counted and (None, True) in counted
    with pytest.raises(ValueError, match="same field paths"):
        chat._by_fingerprint([*chat.LAYOUTS, chat.Layout("again", turns=(("user", ("prompt",)), ("assistant", ("response",))))])


def expected(rows):
    out = {}
    for id_ in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == id_), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        learnt = "".join(r[3] for r in own if r[2] == "assistant")
        out[id_] = len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()
    return out


def test_reading_back_gives_every_text(spark):
    pick = random.Random(2)
    marks = ["\\", "#", "### ", "</turn>", "<", ": ", "\n", "😀", "é", "\\\\", "</turn>\n### assistant: ", "$1", "\x00"]
    rows = []
    for id_ in (None, 1, 2, 3, 4):
        for place in range(pick.randrange(1, 7)):
            rows.append((id_, place, pick.choice(["user", "assistant", "a: b\\", "", "### x"]), "".join(pick.choice(marks) for _ in range(pick.randrange(9)))))
    rows += [(5, 0, "assistant", "<" * 300_000), (5, 1, "user", ""), (6, None, "assistant", "first"), (6, 0, "assistant", "then")]
    df = spark.createDataFrame(rows, "id long, place long, role string, text string").repartition(7)
    said = chat.formatted(df)
    found = {r.id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(said).collect()}
    assert found == expected(rows)
    for r in said.collect():
        assert r.said.count("###") == r.said.count("</turn>") == 1 and (r.loss_from is None or not set("#<") & set(r.said[r.loss_from : r.loss_to]))
    whole = "".join(r.said for r in said.where("id = 5").orderBy("place").collect())
    assert [t for _, t in chat.parsed(whole)] == ["<" * 300_000, ""]
    with pytest.raises(ValueError, match="no turn"):
        list(chat.parsed("### user: a</turn>\nx"))
    assert chat.digests(chat.formatted(df.where("false"))).count() == 0


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")], "id long, place long, role string, text string")
    (r,) = chat.digests(chat.formatted(df)).collect()
    assert r.n_turns == 4 and r.loss_chars == 2 and r.turns_sha256 == hashlib.sha256(b"\n\n\n\nassistant\na\nassistant\na\n").hexdigest()
