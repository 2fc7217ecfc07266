"""Scores of answers from the raw replies of a judge model, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULT, EngineConfig
from lectern.functions import replies
from lectern.plans import prompts
from lectern.providers import Chat, chat_column

METRICS = ("faithfulness", "answer_relevancy", "context_relevancy", "ground_truth_accuracy")


def faithfulness_context(contexts: Column, most: int | None = DEFAULT.judge_context_chars) -> Column:
    """Joined contexts, cut to ``most`` characters for the judge; None cuts nothing."""
    text = F.array_join(contexts, "\n\n---\n\n")
    if most is None:
        return text
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n\n[... truncated ...]"))).otherwise(text)


def numbered_snippets(contexts: Column, most: int | None = DEFAULT.judge_snippet_chars) -> Column:
    """Numbered one-line snippets of at most ``most`` characters each; None cuts nothing."""
    def snippet(text: Column, i: Column) -> Column:
        cut = F.replace(text if most is None else F.left(text, F.lit(most)), F.lit("\n"), F.lit(" "))
        dots = F.lit("") if most is None else F.when(F.length(text) > most, F.lit("...")).otherwise(F.lit(""))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), cut, dots)

    return F.array_join(F.transform(contexts, snippet), "\n")


def judged(answers: DataFrame, judge: Chat, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``answers`` (question, answer, ground_truth, contexts) with the judge's raw reply to each metric's prompt."""
    contexts = F.col("contexts")
    usable = (F.coalesce(F.length("answer"), F.lit(0)) > 0) & (F.size(contexts) > 0)
    whole, snippets = faithfulness_context(contexts, cfg.judge_context_chars), numbered_snippets(contexts, cfg.judge_snippet_chars)
    asked = {
        "faithfulness_raw": (usable, prompts.FAITHFULNESS, (whole, F.col("answer"))),
        "answer_relevancy_raw": (usable, prompts.ANSWER_RELEVANCY, (F.col("question"), F.col("answer"))),
        "context_relevancy_raw": (usable, prompts.CONTEXT_RELEVANCY, (F.col("question"), snippets)),
        "ground_truth_raw": (usable & (F.length("ground_truth") > 0), prompts.GROUND_TRUTH, (F.col("question"), F.col("ground_truth"), F.col("answer"))),
    }
    # without a prompt the judge isn't called
    replies_ = {name: chat_column(F.when(when, F.format_string(text, *values)), judge) for name, (when, text, values) in asked.items()}
    return answers.withColumns({"n_contexts": F.size(contexts), **replies_})


def score_answers(judged: DataFrame, use_ground_truth: bool = True) -> DataFrame:
    """Scores in [0, 1] per question; NULL (and ``skipped``) without an answer or any context.

    ``judged`` has question, answer, n_contexts, ground_truth and one raw reply per metric:
    faithfulness_raw, answer_relevancy_raw, context_relevancy_raw, ground_truth_raw.
    """
    skipped = (F.coalesce(F.length("answer"), F.lit(0)) == 0) | (F.coalesce("n_contexts", F.lit(0)) == 0)
    has_truth = F.lit(use_ground_truth) & (F.coalesce(F.length("ground_truth"), F.lit(0)) > 0)
    return judged.withColumn("skipped", skipped).select(
        "question", "skipped",
        F.when(~F.col("skipped"), replies.supported_ratio("faithfulness_raw")).alias("faithfulness"),
        F.when(~F.col("skipped"), replies.scale_fraction("answer_relevancy_raw")).alias("answer_relevancy"),
        F.when(~F.col("skipped"), replies.passage_score("context_relevancy_raw")).alias("context_relevancy"),
        F.when(~F.col("skipped") & has_truth, replies.scale_fraction("ground_truth_raw")).alias("ground_truth_accuracy"),
    )


def metric_means(scores: DataFrame) -> DataFrame:
    """One row per metric: mean over the scored questions to three decimals, 0 without any."""
    wide = scores.agg(*[F.coalesce(F.round(F.avg(m), 3), F.lit(0.0)).alias(m) for m in METRICS])
    return wide.unpivot([], list(METRICS), "metric", "mean")
