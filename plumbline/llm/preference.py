"""Preference formatting: the turns that two conversations share become the prompt, the others a pair of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _turns(conversations: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): the distinct turns of each conversation in order of turn, role and text (null first)."""
    rows = conversations.where("pair_id is not null").select("pair_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    return rows.distinct().groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(name))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters of the rendered turns, and whether they are trained on: an answer and its end mark are."""

    def runs(t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(t["text"]) + len(CLOSE)
        answer = t["role"] == TRAINED_ROLE
        run = lambda trained, n: F.struct(trained.alias("trained"), n.alias("chars"))
        return F.when(answer, F.array(run(F.lit(False), head), run(F.lit(True), body), run(F.lit(False), F.lit(1)))).otherwise(F.array(run(F.lit(False), head + body + 1)))

    return F.flatten(F.transform(turns, runs))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair_id of both tables (pair_id, turn, role, text).

    Returns pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. The prompt is the longest run
    of turns, from the first, in which role and text agree; it is rendered once. The completions are the turns after it.
    A mask lists runs of characters of its completion in order, each with whether it is trained on.

    Turns are ordered by turn, then role, then text, null first; repeated rows count once. A null role is "unknown", a
    null text empty, and rows without pair_id are left out. Pairs that are in one table only are left out; equal
    conversations give empty completions. Empty tables give no rows. Other columns are ignored. A conversation is one
    training record and is put together in one row.
    """
    both = _turns(chosen, "a").join(_turns(rejected, "b"), "pair_id")
    same = F.transform(F.arrays_zip("a", "b"), lambda t: t["a"].isNotNull() & t["b"].isNotNull() & (t["a"]["role"] == t["b"]["role"]) & (t["a"]["text"] == t["b"]["text"]))
    both = both.withColumn("same", F.transform(same, lambda t: F.coalesce(t, F.lit(False))))
    n = F.when(F.array_contains("same", False), F.array_position("same", False) - 1).otherwise(F.size("same")).cast("int")
    both = both.withColumn("n", n)
    prompt = F.slice("a", F.lit(1), F.col("n"))
    both = both.select("pair_id", "n", prompt.alias("prompt"), *[F.slice(c, F.col("n") + 1, F.size(c)).alias(c) for c in ("a", "b")])
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("prompt")).alias("prompt"), _rendered(F.col("a")).alias("chosen"),
        _rendered(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"),
    )


def stale_answers(conversations: DataFrame) -> DataFrame:
    """Rejected counterparts (pair_id, turn, role, text) of conversations with an answer.

    The last answer is replaced by the answer before it, or by nothing if it is the only one: a reply that ignores what
    was said since. All other turns are kept, so a pair differs from this turn on.
    """
    rows = conversations.where("pair_id is not null and turn is not null")
    answers = rows.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id", "turn").agg(F.min("text").alias("answer"))
    last = answers.groupBy(F.col("pair_id").alias("p")).agg(F.max("turn").alias("last"))
    before = answers.join(last, (F.col("pair_id") == F.col("p")) & (F.col("turn") < F.col("last")))
    before = before.groupBy(F.col("p").alias("q")).agg(F.max_by("answer", "turn").alias("older"))
    rows = rows.join(last, rows["pair_id"] == last["p"]).join(before, F.col("p") == F.col("q"), "left")
    replaced = (F.col("turn") == F.col("last")) & (F.col("role") == TRAINED_ROLE)
    return rows.select("pair_id", "turn", "role", F.when(replaced, F.coalesce("older", F.lit(""))).otherwise(F.col("text")).alias("text"))


def mask_text(mask: Column) -> Column:
    """A mask as text: 0 or 1, a colon and the number of characters, comma-joined."""
    return F.array_join(F.transform(mask, lambda r: F.concat(F.when(r["trained"], "1").otherwise("0"), F.lit(":"), r["chars"].cast("string"))), ",")
