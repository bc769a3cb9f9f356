from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import chat

ODD = ["<|im_end|>\n", "<\\|x", "<\\\\|", "<", "|", "<|", "a<", "<<|im_end|>\n<|im_start|>user\n", "", "\\<|\\", "$1 \\1",
       "x" * 100_000]


def test_marks_in_texts_and_roles_come_back(spark):
    roles = ("assistant", "we|ird\nrole<|")
    df = spark.createDataFrame([(i, [(r, t) for r in roles]) for i, t in enumerate(ODD)],
                               f"id int, turns {chat.TURNS}")
    made = chat.format_turns(chat.canonical_turns(df, "id"))
    rows = made.select("key", chat.parse(chat.formatted()).alias("t"), chat.loss_text().alias("l"),
                       chat.formatted().alias("f")).collect()
    for r in rows:
        text = ODD[r["key"]]
        assert [tuple(x) for x in r["t"]] == [(role, text) for role in roles] and r["l"] == text
        assert r["f"].count(chat.START) == r["f"].count(chat.END) == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\a>\n", max_size=12), min_size=1, max_size=8))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(df["t"]).alias("e"), chat.unescape(chat.escape(df["t"])).alias("u")).collect()
    assert all(r["u"] == r["t"] and "<|" not in r["e"] for r in rows)


LAYOUTS = [
    ("named_struct('from', 'human', 'value', 'q')", None),
    ("select 1 id, array(named_struct('role','user','content','q'), named_struct('role','assistant','content',null)) messages",
     ("messages", [("user", "q"), ("assistant", "")])),
    ("select 1 id, array(named_struct('from','human','value','q'), named_struct('from','gpt','value','a')) conversations",
     ("conversations", [("user", "q"), ("assistant", "a")])),
    ("select 1 id, 'q' prompt, 'a' completion", ("prompt-completion", [("user", "q"), ("assistant", "a")])),
    ("select 1 id, 's' system, 'q' prompt, 'a' response",
     ("system-prompt-response", [("system", "s"), ("user", "q"), ("assistant", "a")])),
    ("select 1 id, 'q' instruction, 'i' input, 'a' output, 7 extra",
     ("instruction-input-output", [("user", "q\n\ni"), ("assistant", "a")])),
    ("select 1 id, 'q' question, 'a' answer", ("question-answer", [("user", "q"), ("assistant", "a")])),
    ("select 1 id, 'q' prompt, 'x' messages", (None, [])),
    ("select 1 id", (None, [])),
]


@pytest.mark.parametrize("sql, want", [x for x in LAYOUTS if x[1]])
def test_layouts(spark, sql, want):
    row = chat.canonical_turns(spark.sql(sql), "id").first()
    assert (row["layout"], [tuple(t) for t in row["turns"]]) == want


def test_rows_of_one_table_choose_their_own_mapping(spark):
    df = spark.sql("select 1 id, 'p' prompt, 'c' completion, cast(null as string) response union all "
                   "select 2, 'p', null, 'r' union all select 3, 'p', null, null union all select 4, 'p', 'c', 'r'")
    got = {r["key"]: r["layout"] for r in chat.canonical_turns(df, "id").collect()}
    assert got == {1: "prompt-completion", 2: "prompt-response", 3: None, 4: None}


def test_rows_by_turn_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"),
            (None, 0, None, "n"), (2, None, "user", "late"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.canonical_turns(chat.gather_turns(df, "conv_id"), "conv_id")
    got = {r["key"]: [tuple(t) for t in r["turns"]] for r in made.collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")],
                   None: [("", "n")], 2: [("user", "late"), ("user", "x")]}
    assert chat.digests(chat.format_turns(made.where("false"))).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat.digests(chat.format_turns(chat.canonical_turns(chat.gather_turns(df, "conv_id"), "conv_id")))
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
