"""Windows keep the budget, for any script and any system turn."""

import random
import re
from collections import Counter

import pytest

from quillstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def tokens(text):
    return len(re.findall(chat.TOKEN, text)) + chat.TURN_TOKENS


def text(r, most):
    kind, n = r.choice("ldcp"), r.randint(0, most)
    return "".join(r.choice({"l": "abc  ", "d": "0123 ", "c": "漢字語", "p": ".,;! é"}[kind]) for _ in range(n))


@pytest.fixture(scope="module")
def many():
    r = random.Random(4)
    rows = []
    for c in range(150):
        if c % 3:
            rows.append((c, -1, "system", text(r, r.choice((20, 100, 260, 400, 2000)))))
        for k in range(r.randint(0, 25)):
            rows.append((c, k, ("user", "assistant")[k % 2], text(r, r.choice((30, 60, 300, 600)))))
    return rows


def turns_of(row):
    return [t.split(chat.SEP, 1) for t in row.formatted.removesuffix(chat.END).removeprefix(chat.START).split(chat.END + chat.START)]


@pytest.mark.parametrize("budget", [64, 200])
def test_no_window_exceeds_the_budget_unless_it_is_one_turn(spark, many, budget):
    out = chat.windows(spark.createDataFrame(many, SCHEMA), budget=budget).collect()
    over = repeated = 0
    for row in out:
        turns = turns_of(row)
        if sum(tokens(t) for _, t in turns) > budget:
            over += 1
            assert len(turns) == 1
        repeated += row.n_context
    assert over and repeated
    own = Counter((row.conv_id, role, t) for row in out for role, t in turns_of(row)[row.n_context :])
    assert own == Counter((c, role, t) for c, _, role, t in many)


def test_a_window_has_the_system_turn_where_it_fits(spark, many):
    budget = 200
    system = {c: t for c, _, role, t in many if role == "system"}
    for row in chat.windows(spark.createDataFrame(many, SCHEMA), budget=budget).collect():
        turns, said = turns_of(row), system.get(row.conv_id)
        if said is not None and row.window and tokens(said) <= budget // 2:
            new = turns[row.n_context :]
            assert (turns[0] == ["system", said]) == (len(new) > 1 or tokens(new[0][1]) <= budget - tokens(said))


def test_scripts_without_spaces_are_cut(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], "漢" * 300) for k in range(20)]
    out = chat.windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) >= 7 and all(len(r.formatted) < 1400 for r in out)
