from plumbline.llm import preference

SCHEMA = "pair_id long, turn long, role string, text string, prompt string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def pairs(spark, a, b):
    return {r.pair_id: r for r in preference.preference_pairs(frame(spark, a), frame(spark, b)).collect()}


def test_common_turns_are_the_prompt(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (1, 4, "user", "why")]
    r = pairs(spark, a, b)[1]
    assert r.n_prompt_turns == 3 and r.prompt == "".join(f"<|im_start|>{x[2]}\n{x[3]}<|im_end|>\n" for x in a[:3])
    assert r.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert r.rejected == "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\nwhy<|im_end|>\n"
    at, trained = 0, ""
    for run in r.rejected_mask:
        trained += r.rejected[at : at + run.chars] * run.trained
        at += run.chars
    assert at == len(r.rejected) and trained == "bad<|im_end|>"


def test_nulls_ties_repeats_and_missing_sides(spark):
    a = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (2, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "user", "same"), (4, 0, "user", "b"), (4, 0, "user", "a")]
    b = [(1, None, "user", "first"), (1, 0, "unknown", ""), (3, 5, "user", "same"), (4, 0, "user", "a"), (5, 0, "user", "x")]
    got = pairs(spark, a, b)
    assert set(got) == {1, 3, 4}
    assert got[1].n_prompt_turns == 2 and got[1].chosen == got[1].rejected == "" and got[1].chosen_mask == []
    assert got[3].n_prompt_turns == 1
    assert got[4].n_prompt_turns == 1 and got[4].chosen == "<|im_start|>user\nb<|im_end|>\n" and got[4].rejected == ""
    assert pairs(spark, [], b) == {} and pairs(spark, a, []) == {}


def test_stale_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "z"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "q")]
    got = sorted(map(tuple, preference.stale_answers(frame(spark, rows)).collect()))
    assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "a"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "")]
