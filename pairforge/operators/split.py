"""Leakage-free splits: all rows of a group go to one of train, val and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.order import hash_order, ranked
from pairforge.schema import SPLITS


def group_id() -> Column:
    """The patient where there is one, else the lesion."""
    return F.when(F.col("patient_id_available"), F.concat(F.lit("patient::"), "patient_id")).otherwise(F.concat(F.lit("lesion::"), "lesion_id"))


def split_sizes(groups: int, train: float, val: float) -> tuple[int, int, int]:
    """Groups of each split: rounded half to even, at least one each."""
    if groups < 3:
        raise ValueError("at least three split groups are required")
    n_train, n_val = max(1, round(groups * train)), max(1, round(groups * val))
    if n_train + n_val >= groups:
        n_train, n_val = max(1, groups - 2), 1
    return n_train, n_val, groups - n_train - n_val


def assign(groups: DataFrame, key: str, seed: int, train: float, val: float) -> DataFrame:
    """(key, split): groups in the order of md5(seed/key), cut at the splits' sizes."""
    n = groups.count()
    n_train, n_val, _ = split_sizes(n, train, val)
    rank = F.col("rank")
    split = F.when(rank < n_train, "train").when(rank < n_train + n_val, "val").otherwise("test")
    return hash_order(groups.select(key), seed, key).select(key, split.alias("split"))


#: Groups that a row of the table of splits tells of.
CODES = 256


def assign_sequential(groups: DataFrame, key: str, seed: int, train: float, val: float) -> DataFrame:
    """The same with the permutation of NumPy's generator over sorted keys, which stay where they are.

    Keys are ranked in parallel. The driver draws the permutation, as it is one stream, and
    sends back a byte for each rank: nine bytes a group are its memory.
    """
    import numpy as np

    placed = ranked(groups.select(key), [key], "_rank")
    n = placed.count()
    n_train, n_val, _ = split_sizes(n, train, val)
    order, codes = np.random.default_rng(seed).permutation(n), np.full(n, 2, np.uint8)
    codes[order[:n_train]], codes[order[n_train : n_train + n_val]] = 0, 1
    rows = [(i, bytearray(codes[i * CODES : (i + 1) * CODES].tobytes())) for i in range(-(-n // CODES))]
    drawn = groups.sparkSession.createDataFrame(rows, "_block long, _codes binary")
    found = placed.withColumn("_block", F.expr(f"_rank div {CODES}")).join(drawn, "_block")
    code = F.conv(F.hex(F.substring("_codes", (F.col("_rank") % CODES + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.select(key, F.element_at(F.array(*map(F.lit, SPLITS)), code + 1).alias("split"))


def split_records(records: DataFrame, seed: int, train: float = 0.7, val: float = 0.15, sequential: bool = False) -> DataFrame:
    """Records with an image, with their group and split."""
    found = records.filter("image_found").withColumn("split_group", group_id())
    groups = found.select("split_group").distinct()
    assigned = (assign_sequential if sequential else assign)(groups, "split_group", seed, train, val)
    return found.join(assigned, "split_group")
