"""Ranks over composite text keys, without a task that sorts a hot group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions.order import in_order, ranked
from pairforge.operators import pairs, split


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield 8
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_are_those_of_sorted_rows(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["b", "a", "é", "Z", None, "\U0001f600", "～"]), rng.choice([None, 3, -1, 20]), f"i{i:04d}") for i in range(500)]
    rng.shuffle(rows)
    got = ranked(spark.createDataFrame(rows, "a string, b int, c string"), ["a", "b", "c"]).collect()
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    want = sorted(rows, key=lambda r: tuple(map(first, r)))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(500))
    assert ranked(spark.createDataFrame([], "a string"), ["a"]).collect() == []


def skewed(spark, n):
    """Nine of ten records in one cell, a third of all of one patient."""
    i = F.col("id")
    cell = F.when(i % 10 == 0, F.concat(F.lit("d"), (i % 7).cast("string"))).otherwise("hot")
    return spark.range(n).select(
        F.lit("train").alias("split"), cell.alias("diagnosis"), F.lit("arm").alias("anatomical_site"), F.concat(F.lit("l"), F.expr("id div 3").cast("string")).alias("lesion_id"),
        F.sha2(i.cast("string"), 256).alias("image_id"), F.when(i % 3 == 0, "p").otherwise(F.concat(F.lit("q"), i.cast("string"))).alias("patient_id"), (i % 5 < 4).alias("patient_id_available"),
    )


def test_no_range_has_twice_the_mean_when_a_cell_has_nearly_all_rows(spark, partitions):
    placed = in_order(skewed(spark, 40_000), ["split", *pairs.ORDER])
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) == partitions and max(sizes) <= 2 * 40_000 / partitions


def test_positions_of_skewed_records(spark, partitions):
    got = [r.asDict() for r in pairs.positions(skewed(spark, 3000)).collect()]
    order = lambda r: tuple(r[c] for c in pairs.ORDER)
    groups = {"all": lambda r: 0, "dx": lambda r: r["diagnosis"], "site": lambda r: r["anatomical_site"], "cell": lambda r: (r["diagnosis"], r["anatomical_site"]), "patient": lambda r: (r["patient_id"] if r["patient_id_available"] else r["image_id"], r["patient_id_available"])}
    assert len(got) == 3000
    for name, key in groups.items():
        members = {}
        for r in sorted(got, key=order):
            members.setdefault(key(r), []).append(r)
        for rows in members.values():
            assert [(r[f"p_{name}"], r[f"n_{name}"]) for r in rows] == [(k, len(rows)) for k in range(len(rows))]


@pytest.mark.parametrize("n", [3, 256, 700])
def test_sequential_split_is_numpys_permutation(spark, partitions, n):
    keys = [f"lesion::{i * 7919 % n}" for i in range(n)]
    got = {r.k: r.split for r in split.assign_sequential(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 11, 0.7, 0.15).collect()}
    n_train, n_val, _ = split.split_sizes(n, 0.7, 0.15)
    ordered = sorted(keys)
    want = {ordered[int(j)]: "train" if i < n_train else "val" if i < n_train + n_val else "test" for i, j in enumerate(np.random.default_rng(11).permutation(n))}
    assert got == want
