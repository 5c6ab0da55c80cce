"""Passes that ask a model: what to ask about, and what becomes of the answers.

The model itself is a callable that is handed in: ``ask(prompts: list[str]) -> list[str]``
answers a batch of prompts within a task (an exception counts as no answer for its batch).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleanse as C
from ..functions import predicates as P
from ..functions import rules as R
from ..sources.scratch import materialised

Ask = Callable[[list[str]], list[str]]
#: Words of performance that a prompt for blind labelling may not hold.
PERFORMANCE_WORDS = ("tier", "大爆", "爆贴", "impressions", "reads", "interactions", "互动数", "阅读数", "曝光", "performance", "实际表现")


def unannotated(notes: DataFrame, again: bool = False) -> DataFrame:
    """Notes with a text that are not annotated yet (all of them, if ``again``)."""
    worth = notes.where(~P.blank(F.col("raw_content")))
    return worth if again else worth.where(F.col("annotated_at").isNull())


def leaks(context: Column) -> Column:
    """Performance words that a prompt's context gives away."""
    return F.array_compact(F.array(*(F.when(F.contains(context, F.lit(w)), w) for w in PERFORMANCE_WORDS)))


def guarded(prompts: DataFrame, context: str = "context") -> DataFrame:
    """``prompts``, whose rows raise an error if their context leaks performance: labels must be blind."""
    found = leaks(F.col(context))
    return prompts.withColumn(context, F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit("context leaks performance: "), F.array_join(found, ", ")))).otherwise(F.col(context)))


def answered(prompts: DataFrame, ask: Ask) -> DataFrame:
    """``prompts`` (id, prompt) with ``answer``, or, where the call failed, null and the ``failure``; written down, so that no call is made twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            failure = None
            try:
                found = ask(pdf["prompt"].tolist())
            except Exception as failed:  # a failed call is an outcome of its rows, which are tried again or reported
                found, failure = [None] * len(pdf), f"{type(failed).__name__}: {failed}"
            yield pdf.assign(answer=pd.Series(found, index=pdf.index, dtype="object"), failure=failure)

    return materialised(prompts.select("id", "prompt").mapInPandas(run, "id string, prompt string, answer string, failure string"))


def with_retry(prompts: DataFrame, ask: Ask, errors: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Valid answers (id, answer, retried) and failures (id, errors, answer), after one more try with what was wrong.

    ``errors`` lists what is wrong with an answer's JSON text; an answer that is no JSON has
    one error.  Failures of the call are not tried again.
    """

    def judged(rows: DataFrame) -> DataFrame:
        json = C.fenced_json(F.col("answer"))
        wrong = F.when(F.col("answer").isNull(), F.array(F.concat_ws(": ", F.lit("call failed"), "failure"))).when(json.isNull(), F.array(F.lit("no JSON"))).otherwise(errors(json))
        return rows.select("id", "prompt", F.col("answer").alias("raw"), json.alias("answer"), wrong.alias("errors"))

    first = judged(answered(prompts, ask))
    bad = (F.size("errors") > 0) & F.col("raw").isNotNull()
    told = F.concat_ws("\n", "prompt", "raw", F.lit("wrong:"), F.array_join("errors", "\n"))
    second = judged(answered(first.where(bad).select("id", told.alias("prompt")), ask))
    fine = F.size("errors") == 0
    valid = first.where(fine).select("id", "answer", F.lit(False).alias("retried")).unionByName(second.where(fine).select("id", "answer", F.lit(True).alias("retried")))
    failed = first.where(F.col("raw").isNull()).unionByName(second.where(~fine)).select("id", "errors", F.col("raw").alias("answer"))
    return valid, failed


def sub_directions(notes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Notes whose direction has sub-directions, each with their ``names``; ``allowed``: direction, name and lifted columns."""
    names = allowed.groupBy("direction").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return notes.join(names, "direction")


def lift_sub_direction(chosen: DataFrame, allowed: DataFrame, lifted: Sequence[str]) -> DataFrame:
    """note_id, ``direction_subtype`` and the lifted columns of each choice (note_id, direction, name); names outside the allowed ones drop out."""
    return chosen.join(allowed, ["direction", "name"]).select("note_id", F.col("name").alias("direction_subtype"), *lifted)


def uncurated(cards: DataFrame, budget: int, again: bool = False) -> DataFrame:
    """The ``budget`` best cards by rank_score (ties by note_id) that have no lesson yet."""
    own = cards if again else cards.where(~F.coalesce("is_curated", F.lit(False)))
    return own.orderBy(F.desc_nulls_last("rank_score"), "note_id").limit(budget)


#: The texts of a lesson.
LESSON = ("hook_type", "structure", "why_it_worked", "transferable_tactic")


def valid_lessons(lessons: DataFrame, fields: Sequence[str] = LESSON) -> DataFrame:
    """Lessons all of whose texts are there, trimmed."""
    own = lessons.where(F.size(R.lesson_errors({c: F.col(c) for c in fields})) == 0)
    return own.withColumns({c: F.trim(c) for c in fields})


def unthreaded(notes: DataFrame, comments: DataFrame) -> DataFrame:
    """Notes with a raw block of comments whose comments none has a parent yet."""
    state = comments.groupBy("note_id").agg(F.count("parent_comment_id").alias("threaded"))
    return notes.where(~P.blank(F.col("comment_block"))).join(state.where("threaded = 0").select("note_id"), "note_id", "left_semi")


def picked_cards(picks: DataFrame, cards: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` picks (request, place, note_id, why) of each request, with their cards; made-up ids drop out."""
    return picks.where(F.col("place") < most).join(cards, "note_id")
