"""Comparisons between runs: seed sweeps, claims with tolerances, summaries, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import outcome


def sweep(values: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample deviation, least, greatest and mean +- 1.96 standard errors."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    out = values.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    half = F.lit(1.96) * F.col("std") / F.sqrt("n")
    return out.select("*", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def check_claims(expected: DataFrame, observed: DataFrame, key: str = "run_id", tolerance: float = 5e-4) -> DataFrame:
    """status of each expectation: PASS, FAIL, or SKIP where the run is not there."""
    joined = expected.select(key, F.col("value").alias("expected")).join(observed.select(key, F.col("value").alias("observed")), key, "left")
    near = F.abs(F.col("observed") - F.col("expected")) <= tolerance
    return joined.withColumn("status", F.when(F.col("observed").isNull(), "SKIP").when(near, "PASS").otherwise("FAIL"))


def score_gap(scores: DataFrame, *group: str) -> DataFrame:
    """Mean score by label, and changing less stable."""
    mean = lambda label: F.avg(F.when(F.col("pair_label") == label, F.col("score")))
    out = scores.groupBy(*group).agg(mean("stable").alias("stable_mean"), mean("changing").alias("changing_mean"))
    return out.withColumn("gap", F.col("changing_mean") - F.col("stable_mean"))


def loss_reduction(first: Column, last: Column) -> Column:
    """Per cent by which a loss fell."""
    return (first - last) / F.nullif(first, F.lit(0.0)) * 100


def stated(text: Column, percent: Column, tolerance: float = 0.5) -> Column:
    """Whether the first percentage in a text is within ``tolerance`` points of a value."""
    number = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double")
    return F.coalesce(F.abs(number - percent) <= tolerance, F.lit(False))


#: What a run's summary takes from its metrics document; anything may be missing or of another type.
SUMMARY = {
    "run_id": ("$.run_id", "string"), "tier": ("$.tier", "string"), "model_id": ("$.model_id", "string"),
    "primary_metric": ("$.primary_metric", "string"), "primary_score": ("$.primary_score", "double"),
    "baseline_name": ("$.result.strongest_baseline.name", "string"), "baseline_auroc": ("$.result.strongest_baseline.auroc", "double"),
    "delta_auroc": ("$.result.delta_auroc_vs_strongest_baseline", "double"), "interpretation": ("$.result.interpretation", "string"),
    "collapsed": ("$.representation_health.collapsed", "boolean"), "runtime_seconds": ("$.training.runtime_seconds", "double"),
    "stable_pairs": ("$.training.stable_pairs_used_for_training", "bigint"), "gate_passed": ("$.acceptance_gate.passed", "boolean"),
    "gate_criterion": ("$.acceptance_gate.criterion", "string"),
}


#: What a value of a document is, by the kind of field that takes it.
SAID = {"string": "^STRING", "double": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "bigint": "^BIGINT", "boolean": "^BOOLEAN"}


def typed(document: Column, path: str, kind: str) -> Column:
    """The value at a path of a variant, null if it is of another kind: true is no number, and "7" neither."""
    said = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(said.rlike(SAID[kind]), F.try_variant_get(document, path, kind))


def summarise(documents: DataFrame, json: str = "json") -> DataFrame:
    """One nullable row of fields for each metrics document, which is parsed once, whatever its shape.

    A text that is no JSON gives nulls, as does a value of another kind than its field's.
    """
    parsed = documents.select(F.try_parse_json(json).alias("v"))
    return parsed.select(*[typed(F.col("v"), path, kind).alias(name) for name, (path, kind) in SUMMARY.items()])


def compared(trained: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row: baseline, baseline_auroc, delta and interpretation, of a trained model (auroc, collapsed) and the best baseline (model, auroc)."""
    both = trained.select(F.col("auroc").alias("own"), "collapsed").join(F.broadcast(baselines.select(F.col("model").alias("baseline"), F.col("auroc").alias("baseline_auroc"))), F.lit(True))
    delta = F.col("own") - F.col("baseline_auroc")
    return both.select("baseline", "baseline_auroc", delta.alias("delta"), outcome(delta, F.col("collapsed")).alias("interpretation"))


def accepted(metrics: DataFrame, least: float = 0.95, override: bool = False) -> DataFrame:
    """One row: the strongest auroc, the criterion and whether it is met or overridden."""
    top = F.max("auroc")
    return metrics.agg(top.alias("strongest"), F.lit(f"strongest AUROC >= {least}").alias("criterion"), (F.coalesce(top >= least, F.lit(False)) | F.lit(override)).alias("passed"))
