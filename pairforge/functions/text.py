"""Strings, labels and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_int(label: Column) -> Column:
    return F.when(label == "changing", 1).otherwise(0)


def first_filled(columns: Sequence[Column]) -> Column:
    """The first column, in order, that is not blank; trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def families(severity: Column) -> Column:
    """The items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(severity, ","), lambda x: F.trim(x)), lambda x: x != "")


def family_at(listed: Column, index: Column) -> Column:
    """The list's items in rotation."""
    return F.get(listed, F.pmod(index, F.size(listed)).cast("int"))


def stable_reason(listed: Column) -> Column:
    name = F.coalesce(F.get(listed, F.lit(0)), F.lit("mild"))
    one = F.when(name.isin("strong", "strong_held_out", "strong_held_out_2"), F.concat(F.lit("same_image_post_split_"), name, F.lit("_nuisance"))).otherwise("same_image_post_split_mild_nuisance")
    return F.when(F.size(listed) > 1, "same_image_post_split_mixed_nuisance").otherwise(one)


def severity(split: Column, base: str, held_out: str | None) -> Column:
    """The nuisance of a split: train always has the base's, the others the held-out one if there is one."""
    return F.when(split == "train", F.lit(base)).otherwise(F.lit(held_out if held_out is not None else base))


def outcome(delta: Column, collapsed: Column) -> Column:
    """How a trained score compares with the strongest baseline."""
    return (
        F.when(collapsed, "collapsed_representation")
        .when(delta >= 0.05, "clear_improvement")
        .when(delta >= 0, "marginal_or_equal")
        .otherwise("below_baseline")
    )


def safe_name(name: Column) -> Column:
    """Letters and digits of any script, - and _ stay; anything else becomes _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def short_number(value: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"0+$", ""), r"\.$", "")
