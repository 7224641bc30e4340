import hashlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat

NASTY = st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", ":", " ", "a", "é", "#", "<", "### x: "]), max_size=12).map("".join)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_round_trip(turns):
    made = [chat.round_trip(*t) for t in turns]
    text = "".join(x[0] for x in made)
    assert [t[:2] for t in chat.parse(text)] == turns
    for (role, said), (rendered, start, end, step) in zip(turns, made, strict=True):
        assert step == 0 or chat.render_turn(role, said, step - 1)[0] != rendered
        assert rendered[start:end] == chat._escaped(said, step)


def test_plain_text_is_not_escaped():
    assert chat.round_trip("user", "a \\n b")[0] == "### user: a \\n b</turn>\n"


def brute_force(rows):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv, turns in groupby(sorted(rows, key=key), key=lambda x: x[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(chat.round_trip(*x)[0] for x in turns)
        yield conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole)


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, part int, tie string").repartition(3)
    found = chat.read_back(chat.render(df, **how)).drop("steps").collect()
    order = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(map(tuple, found), key=order) == list(brute_force(rows))


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "\\### Assistant: </turn> ok\\"), (2, 5, "assistant", "b" * 300000), (2, None, "assistant", "first"), (None, 0, "user", "n"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "a:b\\\n", "")]
    check(spark, rows)
    check(spark, [])


def test_texts_of_one_turn_follow_each_other_by_text(spark):
    check(spark, [(1, 0, "user", x) for x in ("b", "a", "", "ab", "\U0001f600", "\uffff", "B")] + [(1, 0, "assistant", "x" * 64 + y) for y in "badc"])


def test_a_very_long_conversation_is_spread_and_read_in_order(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k} ### </turn>\\") for k in range(3000)] + [(c, 0, "assistant", "x") for c in range(20) if c != 7]
    check(spark, rows, part_chars=2000)
