"""Error analysis: the pairs that scores get most wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Failure modes and the question that a reviewer is asked.
STABLE_HIGH, CHANGING_LOW = "stable_high_score", "changing_low_score"
QUESTIONS = {
    STABLE_HIGH: "Did nuisance variation dominate the score despite no proxy change?",
    CHANGING_LOW: "Is this changing proxy visually too subtle or mismatched for the task?",
}


# The same for a trained model, whose score is the error of its prediction.
MODEL_MODES = {STABLE_HIGH: "stable_high_prediction_error", CHANGING_LOW: "changing_low_prediction_error"}
MODEL_QUESTIONS = {
    STABLE_HIGH: "Did nuisance variation dominate a pair that should remain stable?",
    CHANGING_LOW: "Is this changing proxy visually too subtle or poorly matched?",
}


def review_question(mode: Column) -> Column:
    return F.when(mode == STABLE_HIGH, QUESTIONS[STABLE_HIGH]).otherwise(QUESTIONS[CHANGING_LOW])


def of_model(failures: DataFrame) -> DataFrame:
    """failures() with the modes and questions of a trained model."""
    high = F.col("failure_mode") == STABLE_HIGH
    pick = lambda texts: F.when(high, texts[STABLE_HIGH]).otherwise(texts[CHANGING_LOW])
    return failures.withColumns({"review_question": pick(MODEL_QUESTIONS), "failure_mode": pick(MODEL_MODES)})


def failures(scores: DataFrame, model: str, count: int = 3) -> DataFrame:
    """The ``count`` worst pairs of each model and failure mode.

    ``scores`` has model, pair_id, pair_label, score and ordinal, the pair's place. Stable pairs
    are taken from the highest score down, of equal ones the last first; changing pairs from the
    lowest up, the first first. Ranks are limits within a model and label, so that each task
    keeps ``count`` rows of each before they meet.
    """
    stable = F.col("pair_label") == "stable"
    mode = F.when(stable, STABLE_HIGH).otherwise(CHANGING_LOW)
    worst = F.when(stable, -F.col("score")).otherwise(F.col("score"))
    place = F.when(stable, -F.col("ordinal")).otherwise(F.col("ordinal"))
    keyed = scores.withColumn("failure_mode", mode).withColumn("_w", worst).withColumn("_p", place)
    order = Window.partitionBy(model, "failure_mode").orderBy("_w", "_p")
    ranked = keyed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)
    return ranked.drop("_w", "_p").withColumn("review_question", review_question(F.col("failure_mode")))


def bars(scores: DataFrame, value: str, count: int, order: str) -> DataFrame:
    """The first rows with their value as a share of the greatest among them."""
    shown = scores.orderBy(order).limit(count)
    top = F.max(value).over(Window.partitionBy(F.lit(0)))
    return shown.withColumn("share", F.col(value) / F.when(F.coalesce(top, F.lit(0)) > 0, top).otherwise(F.lit(1.0)))
