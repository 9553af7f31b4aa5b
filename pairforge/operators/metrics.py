"""Ranking metrics of scored, labelled pairs.

A frame of scores has the columns ``label_int`` (1: changing, 0: stable) and ``score``, and any
columns to group by. All metrics start from one row for each distinct score of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.order import hash_order, joined_by, running_sums


def counts_by_score(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each distinct score. Rows without score or label do not count."""
    known = scores.filter("score is not null and label_int is not null")
    return known.groupBy(*group, "score").agg(F.sum("label_int").cast("long").alias("pos"), F.sum(1 - F.col("label_int")).cast("long").alias("neg"))


def invalid_groups(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Groups that no metric is defined for: labels other than 0 and 1, a missing value, or one class only."""
    bad = F.count_if(F.col("label_int").isNull() | F.col("score").isNull() | ~F.coalesce(F.col("label_int").isin(0, 1), F.lit(False)))
    counts = scores.groupBy(*group).agg(F.count("*").alias("n"), bad.alias("n_invalid"), F.count_if(F.col("label_int") == 1).alias("n_pos"), F.count_if(F.col("label_int") == 0).alias("n_neg"))
    return counts.filter("n_invalid > 0 or n_pos = 0 or n_neg = 0")


def auroc(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The share of pairs of a positive and a negative that the score orders rightly, ties half."""
    upto = running_sums(counts_by_score(scores, group), group, "score", ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2.0))
    sums = upto.groupBy(*group).agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*group, (F.col("wins") / F.nullif(F.col("p").cast("double") * F.col("n").cast("double"), F.lit(0.0))).alias("auroc"))


def auprc(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Average precision: precision at each distinct score from the top, weighed by the recall it adds."""
    upto = running_sums(counts_by_score(scores, group), group, "score", ["pos", "neg"], descending=True)
    gain = F.sum(F.col("pos").cast("double") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto")))
    return upto.groupBy(*group).agg((gain / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("auprc"))


def roc_points(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The ROC curve from the top down: idx, threshold, tp, fp, tpr and fpr.

    Points within a straight stretch are left out, as they change neither the curve nor its
    error rates; the origin comes first, with an infinite threshold.
    """
    group = list(group)
    counts = counts_by_score(scores, group)
    upto = running_sums(counts, group, "score", ["pos", "neg"], descending=True, following=["pos", "neg"])
    # A stretch is straight while each score adds as many of both classes as the next one.
    first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    bend = F.coalesce((F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")), F.lit(True)) | first
    points = upto.filter(bend).select(*group, F.col("score").cast("double").alias("threshold"), F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.lit(1).alias("one"))
    numbered = running_sums(points, group, "threshold", ["one"], descending=True).drop("one").withColumnRenamed("one_upto", "idx")
    whole = counts.groupBy(*group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    zero = F.lit(0).cast("long")
    start = whole.filter("p is not null").select(*group, F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"), zero.alias("idx"))
    curve = joined_by(start.unionByName(numbered), whole, group, ["p", "q"])
    rate = lambda c, n: F.col(c) / F.nullif(F.col(n).cast("double"), F.lit(0.0))
    return curve.select(*group, F.col("idx").cast("int").alias("idx"), "threshold", "tp", "fp", rate("tp", "p").alias("tpr"), rate("fp", "q").alias("fpr"))


def equal_error(points: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """eer_threshold and equal_error_rate: at the first point where FPR and FNR are nearest."""
    fnr = 1 - F.col("tpr")
    best = F.min(F.struct(F.abs(F.col("fpr") - fnr).alias("gap"), "idx", "threshold", ((F.col("fpr") + fnr) / 2).alias("rate"))).alias("best")
    return points.groupBy(*group).agg(best).select(*group, F.col("best.threshold").alias("eer_threshold"), F.col("best.rate").alias("equal_error_rate"))


def fpr_at_tpr(points: DataFrame, tpr: float, group: Sequence[str] = ()) -> DataFrame:
    """The least false positive rate among points with at least this true positive rate; else 1."""
    least = F.min(F.when(F.col("tpr") >= tpr, F.col("fpr")))
    return points.groupBy(*group).agg(F.coalesce(least, F.lit(1.0)).alias("fpr_at_fixed_tpr"))


def _draw(seed: int, replicate: Column, draw: Column, n: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), replicate, draw))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n)


def bootstrap_native(scores: DataFrame, key: str, samples: int, level: float, seed: int) -> DataFrame:
    """auroc_ci_low and auroc_ci_high from resamples of rows whose draws are hashes.

    Rows are numbered by a hash of ``key``, so no task orders all of them. Draws of a replicate are counted by row before the rows are joined, and by distinct score
    before ranks are taken. Replicates with one class are left out; if none is left both ends
    are the plain value. Reruns agree; the numbers are not those of a sequential generator.
    """
    numbered = hash_order(scores.select(key, "label_int", "score"), seed, key, "at").select("label_int", "score", F.col("at").cast("long").alias("at"))
    n = scores.count()
    spark = scores.sparkSession
    # Replicate and draw from one range, so that draws are made in parallel.
    ids = spark.range(samples * n).select(F.expr(f"id div {max(n, 1)}L").alias("b"), (F.col("id") % max(n, 1)).alias("i"))
    drawn = ids.select("b", _draw(seed, F.col("b"), F.col("i"), F.lit(max(n, 1))).alias("at")).groupBy("b", "at").agg(F.count("*").alias("times"))
    joined = drawn.join(numbered, "at")
    sums = joined.groupBy("b", "score").agg(F.sum(F.col("label_int") * F.col("times")).alias("pos"), F.sum((1 - F.col("label_int")) * F.col("times")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = sums.withColumn("below", below).groupBy("b").agg(F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2.0)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    values = wins.filter("p > 0 and q > 0").select((F.col("wins") / (F.col("p").cast("double") * F.col("q"))).alias("v"))
    alpha = 1 - level
    ends = values.agg(F.percentile("v", alpha / 2).alias("lo"), F.percentile("v", 1 - alpha / 2).alias("hi"))
    return ends.join(auroc(scores), F.lit(True)).select(F.coalesce("lo", "auroc").alias("auroc_ci_low"), F.coalesce("hi", "auroc").alias("auroc_ci_high"))


#: Factors that bits of 32-bit numbers are mixed with, and how far replicates lie apart.
MIX, APART, LOW = (2146121005, 2221713035), 2654435769, (1 << 32) - 1


def poisson_limits(most: int = 16) -> list[int]:
    """By k, the 32-bit numbers from which on a Poisson variable of mean 1 is above k."""
    from math import exp, factorial

    return [int(sum(exp(-1) / factorial(i) for i in range(k + 1)) * (1 << 32)) for k in range(most) if sum(exp(-1) / factorial(i) for i in range(k + 1)) * (1 << 32) < LOW]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(MIX[0])) & np.uint64(LOW)
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(MIX[1])) & np.uint64(LOW)
    return x ^ (x >> np.uint64(16))


class Replicates:
    """What a stretch of rows, in the order of their scores, tells of each replicate: a mergeable sum.

    p and n are the weights of positives and negatives, w twice the wins of positives over
    negatives, ties half. Those of the least and the greatest score are kept apart, as the rows
    of a score may lie in two stretches.
    """

    def __init__(self, samples: int) -> None:
        self.p, self.n, self.w = (np.zeros(samples, np.int64) for _ in range(3))
        self.first: tuple[float, np.ndarray, np.ndarray] | None = None
        self.last: tuple[float, np.ndarray, np.ndarray] | None = None
        self.one = True

    def add(self, scores: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Groups of rising scores, none below the last one: their weights by replicate."""
        if self.last is not None and self.last[0] == scores[0]:
            # The group goes on: it wins over what lies below it, and ties with itself.
            old_p, old_n = self.last[1], self.last[2]
            below = self.n - old_n
            self.w += p[0] * (2 * below + old_n + n[0]) + old_p * n[0]
            self.p, self.n = self.p + p[0], self.n + n[0]
            self.last = (scores[0], old_p + p[0], old_n + n[0])
            if self.one:
                self.first = self.last
            scores, p, n = scores[1:], p[1:], n[1:]
        if len(scores):
            below = self.n + np.cumsum(n, axis=0) - n
            self.w += (p * (2 * below + n)).sum(axis=0)
            self.p, self.n = self.p + p.sum(axis=0), self.n + n.sum(axis=0)
            if self.first is None:
                self.first = (scores[0], p[0], n[0])
                self.one = len(scores) == 1
            else:
                self.one = False
            self.last = (scores[-1], p[-1], n[-1])

    def merge(self, after: Replicates) -> None:
        """Add the stretch that comes next."""
        if after.first is None:
            return
        if self.first is None:
            self.__dict__.update(after.__dict__)
            return
        meet = self.last[0] == after.first[0]
        self.w = self.w + after.w + 2 * after.p * self.n
        if meet:
            self.w = self.w - after.first[1] * self.last[2] + self.last[1] * after.first[2]
        joined = (self.last[0], self.last[1] + after.first[1], self.last[2] + after.first[2])
        if meet and self.one:
            self.first = joined
        self.last = joined if meet and after.one else after.last
        self.one = meet and self.one and after.one
        self.p, self.n = self.p + after.p, self.n + after.n


def replicate_weights(keys: np.ndarray, samples: int) -> np.ndarray:
    """rows x samples: how often each replicate takes each row, Poisson variables of mean 1 from 32-bit keys."""
    limits = np.array(poisson_limits(), np.uint64)
    apart = (np.arange(samples, dtype=np.uint64) * np.uint64(APART)) & np.uint64(LOW)
    return np.searchsorted(limits, _mixed(_mixed(keys.astype(np.uint64))[:, None] ^ apart[None, :]), side="right")


def bootstrap_merged(scores: DataFrame, key: str, samples: int, level: float, seed: int) -> DataFrame:
    """auroc_ci_low and auroc_ci_high from replicates that take each row a Poisson number of times.

    The weights come from hashes of row and replicate where the row is, so there is no table of
    draws. Rows are dealt once, into ranges of score and key; a task goes through its range in
    order and sends three sums a replicate, which are merged. Rows of one score may lie in several
    ranges. Replicates with one class are left out; if none is left both ends are the plain value.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key))), 1, 8), 16, 10).cast("long")
    rows = scores.filter("score is not null and label_int is not null").select(F.col("score").cast("double").alias("score"), F.col("label_int").cast("long").alias("y"), digest.alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = Replicates(samples)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s, y, k = (c.to_numpy() for c in b.slice(at, 512).columns)
                w, starts = replicate_weights(k, samples), np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                found.add(s[starts], np.add.reduceat(w * y[:, None], starts, axis=0), np.add.reduceat(w * (1 - y)[:, None], starts, axis=0))
        if found.first is not None:
            parts = [found.p, found.n, found.w, *found.first[1:], *found.last[1:]]
            data = np.stack(parts).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([found.first[0]]), pa.array([found.last[0]]), pa.array([found.one]), pa.array([data], pa.binary())], ["part", "low", "high", "one", "sums"])

    ordered = rows.repartitionByRange("score", "k").sortWithinPartitions("score", "k").select("score", "y", "k")
    whole = Replicates(samples)
    for r in sorted(ordered.mapInArrow(run, "part int, low double, high double, one boolean, sums binary").collect(), key=lambda r: r.part):  # a row a range
        p, n, w, first_p, first_n, last_p, last_n = np.frombuffer(r.sums, np.int64).reshape(7, samples)
        part = Replicates(samples)
        part.p, part.n, part.w, part.one, part.first, part.last = p, n, w, r.one, (r.low, first_p, first_n), (r.high, last_p, last_n)
        whole.merge(part)
    some = (whole.p > 0) & (whole.n > 0)
    values, alpha = whole.w[some] / (2.0 * whole.p[some] * whole.n[some]), 1 - level
    low, high = np.quantile(values, [alpha / 2, 1 - alpha / 2]).tolist() if len(values) else (None, None)
    plain = auroc(scores)
    kind = lambda v: F.lit(v).cast("double")
    return plain.select(F.coalesce(kind(low), F.col("auroc")).alias("auroc_ci_low"), F.coalesce(kind(high), F.col("auroc")).alias("auroc_ci_high"))


def bootstrap_sequential(scores: DataFrame, group: Sequence[str], order: Sequence[str], samples: int, level: float, seed: int | dict[str, int]) -> DataFrame:
    """The same interval from one sequential NumPy generator for each group, over its rows in order.

    ``seed`` may give each value of the first group column its own.

    Groups are evaluation sets of thousands of rows; each is drawn in one task, because its
    draws share one stream. Use bootstrap_native where a group is large.
    """
    import pandas as pd

    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        y, s = rows["label_int"].to_numpy(), rows["score"].to_numpy(float)

        def area(y: np.ndarray, s: np.ndarray) -> float:
            values, at = np.unique(s, return_inverse=True)
            neg = np.bincount(at, weights=1 - y, minlength=len(values))
            pos = np.bincount(at, weights=y, minlength=len(values))
            return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))

        rng, found = np.random.default_rng(seed[key[0]] if isinstance(seed, dict) else seed), []
        for _ in range(samples):
            drawn = rng.choice(np.arange(len(y)), size=len(y), replace=True)
            if 0 < y[drawn].sum() < len(y):
                found.append(area(y[drawn], s[drawn]))
        alpha = 1 - level
        ends = np.quantile(found, [alpha / 2, 1 - alpha / 2]) if found else [area(y, s)] * 2
        return pd.DataFrame([[*key, *ends]], columns=[*group, "auroc_ci_low", "auroc_ci_high"])

    kinds = ", ".join(f"{g} {scores.schema[g].dataType.simpleString()}" for g in group)
    return scores.groupBy(*group).applyInPandas(run, f"{kinds}, auroc_ci_low double, auroc_ci_high double")


def metric_summary(scores: DataFrame, group: Sequence[str] = (), fixed_tpr: float = 0.8) -> DataFrame:
    """AUROC, average precision, equal-error point and FPR at a fixed TPR of each group, in one row.

    All come from one running sum over the distinct scores, so these are counted and ordered once.
    A null group is a group; one with a single class has nulls, and 1 as its FPR at a fixed TPR.
    """
    group = list(group)
    counts = counts_by_score(scores, group)
    upto = running_sums(counts, group, "score", ["pos", "neg"], descending=True, following=["pos", "neg"])
    whole = counts.groupBy(*group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    rows = joined_by(upto, whole, group, ["p", "q"])
    tpr, fpr = F.col("pos_upto") / F.nullif(F.col("p").cast("double"), F.lit(0.0)), F.col("neg_upto") / F.nullif(F.col("q").cast("double"), F.lit(0.0))
    # Of points in a straight stretch, as in roc_points(), only the ends count.
    first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    bend = F.coalesce((F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")), F.lit(True)) | first
    point = lambda gap, threshold, rate: F.struct(gap.alias("gap"), (-threshold).alias("down"), rate.alias("rate"))
    score = F.col("score").cast("double")
    origin = point(F.lit(1.0), F.lit(float("inf")), F.lit(0.5))
    sums = rows.groupBy(*group).agg(
        F.sum(F.col("pos").cast("double") * (F.col("q") - F.col("neg_upto") + F.col("neg") / 2.0)).alias("wins"),
        F.sum(F.col("pos").cast("double") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))).alias("gain"),
        F.min(F.when(bend & tpr.isNotNull() & fpr.isNotNull(), point(F.abs(fpr - (1 - tpr)), score, (fpr + (1 - tpr)) / 2))).alias("best"),
        F.min(F.when(bend & (tpr >= fixed_tpr), fpr)).alias("fpr_at"),
        F.max("p").alias("p"), F.max("q").alias("q"),
    )
    best = F.when(F.col("best").isNotNull(), F.least("best", origin))
    return sums.select(
        *group, (F.col("wins") / F.nullif(F.col("p").cast("double") * F.col("q").cast("double"), F.lit(0.0))).alias("auroc"),
        (F.col("gain") / F.nullif(F.col("p").cast("double"), F.lit(0.0))).alias("auprc"),
        (-best["down"]).alias("eer_threshold"), best["rate"].alias("equal_error_rate"),
        F.coalesce("fpr_at", F.lit(1.0)).alias("fpr_at_fixed_tpr"), F.lit(fixed_tpr).alias("fixed_tpr"),
    )


def strongest(metrics: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The row with the greatest auroc; of equals, the first by ordinal."""
    best = F.max_by(F.struct(*metrics.columns), F.struct("auroc", -F.col(ordinal)))
    return metrics.agg(best.alias("best")).filter("best is not null").select("best.*")


def collapse_checks(vectors: DataFrame, column: str = "prediction") -> DataFrame:
    """Norms of vectors and variances of their dimensions; collapsed if either mean vanishes."""
    from pairforge.functions.vectors import norm

    norms = vectors.agg(F.avg(norm(F.col(column))).alias("prediction_norm_mean"), F.min(norm(F.col(column))).alias("prediction_norm_min"))
    spread = vectors.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    spread = spread.agg(F.avg("v").alias("dimension_variance_mean"), F.min("v").alias("dimension_variance_min"))
    both = norms.join(F.broadcast(spread), F.lit(True))
    return both.withColumn("collapsed", (F.col("prediction_norm_mean") <= 1e-8) | (F.col("dimension_variance_mean") <= 1e-8))


def score_histogram(scores: DataFrame, low: float, high: float, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of [low, high]; the last bin includes its upper edge."""
    inside = scores.filter(F.col("score").between(low, high))
    width = (high - low) / bins or 1.0  # all scores alike: one bin
    at = F.least(F.floor((F.col("score") - low) / width), F.lit(bins - 1)).cast("long")
    return inside.groupBy(*group, at.alias("bin")).agg(F.count("*").alias("n"))
