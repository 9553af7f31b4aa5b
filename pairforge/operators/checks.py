"""Integrity checks of manifests and inputs: each is a query of the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.schema import LABELS, SPLITS


class InvalidData(ValueError):
    """Raised by validate(); its text names the rules and gives examples."""


def _broken(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids on two or more rows, and on how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def split_overlap(pairs: DataFrame, context: str, target: str) -> DataFrame:
    """(left_split, right_split, value): values of either side of a pair that two splits have."""
    both = pairs.select("split", F.explode(F.array_distinct(F.array(context, target))).alias("value")).filter("value is not null")
    found = both.groupBy("value").agg(F.collect_set("split").alias("splits")).filter("size(splits) > 1")
    return _in_pairs(found, "value").select("left_split", "right_split", "value")


def _in_pairs(found: DataFrame, *keep: str) -> DataFrame:
    """Each two of the known splits in ``splits``, in their order, with the kept columns."""
    ordered = F.filter(F.array(*map(F.lit, SPLITS)), lambda s: F.array_contains("splits", s))
    left = found.select(*keep, F.posexplode(ordered).alias("i", "left_split"), ordered.alias("splits"))
    return left.select("left_split", F.explode(F.slice("splits", F.col("i") + 2, F.size("splits"))).alias("right_split"), *keep)


def manifest_violations(pairs: DataFrame) -> DataFrame:
    """(rule, detail) of everything that is wrong with a manifest."""
    pair = F.col("pair_id")
    same = F.col("context_lesion_id") == F.col("target_lesion_id")
    found = _broken(duplicate_ids(pairs, "pair_id"), "unique pair_id", pair)
    row_rules = {
        "known split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "known label": ~F.coalesce(F.col("pair_label").isin(*LABELS), F.lit(False)),
        "preprocessing profile": F.coalesce(F.col("preprocessing_profile"), F.lit("")) == "",
        "stable pairs keep the lesion": (F.col("pair_label") == "stable") & ~F.coalesce(same, F.lit(False)),
        "changing pairs change the lesion": (F.col("pair_label") == "changing") & F.coalesce(same, F.lit(True)),
    }
    # One pass over the rows for all rules of single rows.
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in row_rules.items()]))
    rows = pairs.select(pair, F.explode(broken).alias("rule")).select("rule", F.col("pair_id").cast("string").alias("detail"))
    found = found.unionByName(rows)
    # Values of both sides of a pair, of lesions and of patients, in one pass.
    sides = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{side}_{kind}_id").cast("string").alias("value")) for kind in ("lesion", "patient") for side in ("context", "target")])
    values = pairs.select("split", F.explode(F.array_distinct(sides)).alias("v")).select("split", "v.kind", "v.value").filter("value is not null")
    met = values.groupBy("kind", "value").agg(F.collect_set("split").alias("splits")).filter("size(splits) > 1")
    detail = F.concat_ws(" ", "left_split", "right_split", "value")
    found = found.unionByName(_in_pairs(met, "kind", "value").select(F.concat("kind", F.lit(" in one split")).alias("rule"), detail.alias("detail")))
    labels = pairs.groupBy("split").agg(F.collect_set("pair_label").alias("labels"))
    lacking = labels.filter(F.size(F.array_intersect("labels", F.array(*map(F.lit, LABELS)))) < len(LABELS))
    found = found.unionByName(_broken(lacking, "both labels in each split", F.col("split")))
    empty = pairs.agg(F.count("*").alias("n")).filter("n = 0")
    return found.unionByName(_broken(empty, "manifest not empty", F.lit("")))


def record_violations(records: DataFrame, missing_allowed: bool = False) -> DataFrame:
    """(rule, detail): ids twice, images missing, fewer than six images."""
    found = _broken(duplicate_ids(records, "image_id"), "unique image_id", F.col("image_id"))
    if not missing_allowed:
        found = found.unionByName(_broken(records.filter("not image_found"), "image present", F.col("image_id")))
    few = records.agg(F.count_if("image_found").alias("n")).filter("n < 6")
    return found.unionByName(_broken(few, "at least six images", F.col("n")))


def split_violations(split_records: DataFrame, stable: int, changing: int) -> DataFrame:
    """(rule, detail): splits with under two lesions or fewer images than pairs are wanted."""
    sizes = split_records.groupBy("split").agg(F.countDistinct("lesion_id").alias("lesions"), F.count("*").alias("images"))
    spark = split_records.sparkSession
    every = spark.createDataFrame([(s,) for s in SPLITS], "split string").join(sizes, "split", "left").na.fill(0)
    lesions = _broken(every.filter("lesions < 2"), "two lesions in each split", F.col("split"))
    return lesions.unionByName(_broken(every.filter(F.col("images") < max(stable, changing)), "an image for each pair", F.col("split")))


def short_of_pairs(pairs: DataFrame, changing: int) -> DataFrame:
    """(split, n): known splits with fewer changing pairs than are wanted."""
    every = pairs.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = pairs.groupBy("split").agg(F.count_if(F.col("pair_label") == "changing").alias("n"))
    return every.join(counts, "split", "left").na.fill(0, ["n"]).filter(F.col("n") < changing)


def training_rows(pairs: DataFrame) -> DataFrame:
    """One row: how many stable pairs there are to fit on, to validate on, and whether the fitted ones stand in for the latter."""
    stable = lambda part: F.count_if((F.col("split") == part) & (F.col("pair_label") == "stable"))
    return pairs.agg(stable("train").alias("fitted"), stable("val").alias("validated")).withColumn("stand_in", F.col("validated") == 0)


def missing_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids of pairs that have no vector."""
    ids = pairs.select(F.explode(F.array("context_image_id", "target_image_id")).alias("image_id")).distinct()
    return ids.join(vectors, "image_id", "left_anti")


def validate(violations: DataFrame, show: int = 20) -> None:
    """Raise InvalidData with each broken rule, its count and an example if there is any row."""
    rules = violations.groupBy("rule").agg(F.count("*").alias("n"), F.min("detail").alias("example")).orderBy("rule").limit(50).collect()
    if rules:
        raise InvalidData("; ".join(f"{r.rule}: {r.n} ({r.example})" for r in rules[:show]))
