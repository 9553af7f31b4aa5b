"""Ranks and running sums over whole tables without a task that gets all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.sinks.scratch import stored

#: Ranges that the rows of a group are dealt into: EDGES * EDGES, about equally filled.
EDGES = 12
#: Groups that are sent to all tasks, at most.
FEW_GROUPS = 50_000


def hash_order(df: DataFrame, seed: int, key: str, name: str = "rank") -> DataFrame:
    """df with the 0-based rank of each row by md5(seed/key), ties by key.

    The first three hex digits deal rows into 4096 buckets; only counts of buckets meet in one
    place, and each bucket is ordered by itself.
    """
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key)))
    dealt = df.withColumn("_md5", digest).withColumn("_bucket", F.substring("_md5", 1, 3))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_bucket", before.alias("_before")))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_md5", key)) - 1
    return dealt.join(starts, "_bucket").withColumn(name, F.col("_before") + place).drop("_md5", "_bucket", "_before")


#: Within the place that a row is written with: the range's number stands above these bits, the row's own below.
RANGE_BITS = 33


def in_order(df: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """df, written in the order of its keys, with ``_range`` and ``_inside``: its range, and its 0-based place there.

    ``_place`` is both in one number, by which files and their parts can be left out of a scan.
    ``path``, if given, is where the table is written, for a caller that deletes it.

    Ranges are cut at sampled values of the whole key, so they hold like numbers of rows however
    many share its first columns. Columns of all types order rows, nulls first; strings by code
    point. Rows equal in all keys lie in one range, in any order.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # Numbers are kept as they are written, so ranges need not come out the same when they are read.
    written = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "ordered", path)
    return written.withColumns({"_range": F.shiftright("_place", RANGE_BITS), "_inside": F.col("_place").bitwiseAND((1 << RANGE_BITS) - 1)})


def ranked(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """df with the 0-based rank of each row in the order of its keys; only counts of ranges meet in one place."""
    placed = in_order(df, keys)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    return placed.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_place", "_before")


def joined_by(left: DataFrame, right: DataFrame, group: Sequence[str], take: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """left with columns of right, which has a row a group; without groups it is one row."""
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + list(also)
    pair = left.alias("a").join(right.alias("b"), on) if on else left.alias("a").join(F.broadcast(right.alias("b")), F.lit(True))
    return pair.select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in take])


def in_ranges(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """df with ``_bucket``: a number of a range of ``order`` within the group, rising with it.

    Ranges end at approximate quantiles, so they hold like numbers of rows however the values are
    spread. An edge is looked up in two steps of EDGES comparisons.
    """
    steps = [i / (EDGES * EDGES) for i in range(1, EDGES * EDGES)]
    value = F.col(order).cast("double")
    edges = df.groupBy(*group).agg(F.percentile_approx(value, steps, 10_000).alias("_edges"))
    spread = joined_by(df, edges, group, ["_edges"])
    below = lambda listed: F.size(F.filter(listed, lambda e: e < value))
    coarse = F.transform(F.sequence(F.lit(EDGES), F.lit(EDGES * (EDGES - 1)), F.lit(EDGES)), lambda i: F.element_at("_edges", i))
    spread = spread.withColumn("_row", below(coarse))
    return spread.withColumn("_bucket", F.col("_row") * EDGES + below(F.slice("_edges", F.col("_row") * EDGES + 1, EDGES))).drop("_edges", "_row")


def running_sums(df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], descending: bool = False, following: Sequence[str] = ()) -> DataFrame:
    """df with ``<value>_upto`` for each value: its sum over the group up to and with each row.

    ``order`` is a number, unique within the group. Rows are dealt into ranges of it; sums of
    ranges are added up first, then each range is summed by itself. With ``following``, there is
    ``<name>_next``, too: that of the next row, null for the last.
    """
    group = list(group)
    dealt = in_ranges(df, group, order)
    key, inside = (F.col("_bucket").desc(), F.col(order).desc()) if descending else (F.col("_bucket"), F.col(order))
    head = F.struct((-F.col(order) if descending else F.col(order)).alias("_at"), *following)
    sums = dealt.groupBy(*group, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values], F.min(head).alias("_head"))
    ranges = Window.partitionBy(*group, F.lit(0)).orderBy(key)
    up = ranges.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_bucket", F.lead("_head").over(ranges).alias("_head"), *[F.coalesce(F.sum(f"_s_{v}").over(up), F.lit(0)).alias(f"_b_{v}") for v in values])
    both = joined_by(dealt, starts, group, ["_head", *[f"_b_{v}" for v in values]], [F.col("a._bucket") == F.col("b._bucket")])
    rows = Window.partitionBy(*group, "_bucket").orderBy(inside)
    upto = [(F.col(f"_b_{v}") + F.sum(v).over(rows.rowsBetween(Window.unboundedPreceding, 0))).alias(f"{v}_upto") for v in values]
    last = F.lead(F.lit(1)).over(rows).isNull()
    after = [F.when(last, F.col(f"_head.{c}")).otherwise(F.lead(c).over(rows)).alias(f"{c}_next") for c in following]
    return both.select("*", *upto, *after).drop("_bucket", "_head", *[f"_b_{v}" for v in values])


def rounded_means(df: DataFrame, group: Sequence[str], value: str, digits: int, at: Sequence[str]) -> DataFrame:
    """(group, value): the mean of each group to so many digits, its doubles added up in the order of ``at``.

    A sum of doubles depends on the order of its additions, and so does the rounding of a mean on a
    tie. Means farther from one than n additions may err round alike in any order. Only the rows of
    the other groups are put in order and added up one by one.
    """
    group, scale, given = list(group), 10**digits, F.col(value)
    sums = df.groupBy(*group).agg(F.avg(given).alias("_mean"), F.avg(F.abs(given)).alias("_size"), F.count(given).alias("_n"))
    means = stored(sums, "means")
    scaled = F.abs(F.col("_mean")) * scale
    near = F.coalesce(F.abs(scaled - F.floor(scaled) - 0.5) <= (F.col("_n") + 4) * F.col("_size") * scale * 2.0**-50, F.lit(False))
    tied = means.filter(near).select(*group)
    few = tied.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    rows = df.alias("a").join((F.broadcast(tied) if few else tied).alias("b"), same, "left_semi")
    ordered = Window.partitionBy(*group).orderBy(*at)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(*group, (F.sum(given).over(upto) / F.count(given).over(upto)).alias("_mean"), F.lead(F.lit(1)).over(ordered).isNull().alias("_last"))
    both = means.filter(~near).select(*group, "_mean").unionByName(summed.filter("_last").select(*group, "_mean"))
    return both.select(*group, F.round("_mean", digits).alias(value))
