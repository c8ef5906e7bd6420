from tidemark.llm import preferences as P


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, n int"
    c = [(1, 0, "user", "Hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "é?"), (1, 3, "assistant", "aa"), (2, 0, "user", "only chosen"), (4, 0, "user", "same"), (4, 1, "assistant", "same"), (None, 0, "user", "x"), (5, 0, None, None), (6, 1, "user", "a"), (6, 1, "user", "a")]
    r = [(1, 1, "assistant", "yes"), (1, 0, "user", "Hi"), (1, 2, "user", "other"), (3, 0, "assistant", "only rejected"), (4, 1, "assistant", "same"), (4, 0, "user", "same"), (5, 0, "", ""), (6, 1, "user", "a")]
    got = {x.pair_id: x for x in P.format_preferences(spark.createDataFrame([(*x, 1) for x in c], schema), spark.createDataFrame([(*x, 1) for x in r], schema)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    x = got[1]
    assert (x.n_prompt_turns, x.prompt) == (2, render([("user", "Hi"), ("assistant", "yes")]))
    assert x.chosen == render([("user", "é?"), ("assistant", "aa")]) and x.rejected == render([("user", "other")])
    assert [x.chosen[s.start : s.end] for s in x.chosen_spans] == ["aa<|im_end|>\n"] and x.rejected_spans == []
    assert (got[2].prompt, got[2].rejected) == ("", "") and got[3].chosen == "" and [tuple(s) for s in got[3].rejected_spans] == [(22, 46)]
    assert (got[4].chosen, got[4].rejected, got[4].n_prompt_turns) == ("", "", 2)
    assert got[5].n_prompt_turns == 1 and got[6].n_prompt_turns == 1 and got[6].chosen == render([("user", "a")])
    empty = spark.createDataFrame([], schema)
    assert P.format_preferences(empty, empty).count() == 0


def test_swapped(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "bye"), (1, 0, "user", "w"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (2, 1, "assistant", "z"), (4, 0, "user", "no answer")]
    c, r = P.swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.pair_id: (x.n_prompt_turns, x.chosen, x.rejected) for x in P.format_preferences(c, r).collect()}
    assert got[0] == (1, render([("assistant", "a0"), ("user", "bye")]), render([("assistant", "a1")]))
    assert got[1] == (1, render([("assistant", "a1")]), render([("assistant", "a0")]))
    assert got[2] == (1, render([("assistant", "z")]), "") and got[4] == (1, "", "")
