"""Matched pairs: anchors in sort order, targets by rank with the anchor's own lesion left out.

A target is element t of a sorted group without the rows of the anchor's lesion. With n rows
in the group, of which the lesion has those at positions E, t is taken modulo n - |E| and
moved past each position of E that it reaches. So no anchor is joined with its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.order import ranked
from pairforge.schema import MATCHES

ORDER = ("diagnosis", "anatomical_site", "lesion_id", "image_id")


def positions(records: DataFrame) -> DataFrame:
    """Records with their positions in sort order: within the split and the groups they are matched in.

    Rows are ranked once by the whole order and, those with a patient, once by patient: both by
    sampled ranges, so that no task sorts a split, a cell or a patient. All other positions add
    the sizes of the (diagnosis, site) cells before. Image ids are taken to be unique.
    """
    cell = ["split", "diagnosis", "anatomical_site"]
    placed = ranked(records, ["split", *ORDER], "_rank")
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n_cell"))

    def before(*keys: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(*[c for c in cell if c not in keys]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n_cell").over(w), F.lit(0))

    def whole(*keys: str) -> Column:
        return F.sum("n_cell").over(Window.partitionBy(*keys))

    # A row for each cell from here on: cells are named collections.
    cells = sizes.withColumn("_one", F.lit(0)).select(
        *cell, "n_cell", before("_one").alias("_first"), before("split").alias("all_at"), whole("split").alias("n_all"),
        before("split", "diagnosis").alias("dx_at"), whole("split", "diagnosis").alias("n_dx"),
        before("split", "anatomical_site").alias("site_at"), whole("split", "anatomical_site").alias("n_site"),
    )
    placed = placed.join(cells, cell).withColumn("p_cell", F.col("_rank") - F.col("_first"))
    placed = placed.select(*records.columns, "p_cell", "n_cell", *[
        expr for name in ("dx", "site", "all") for expr in ((F.col(f"{name}_at") + F.col("p_cell")).alias(f"p_{name}"), F.col(f"n_{name}"))
    ])
    patient = ["split", "patient_id"]
    theirs = ranked(placed.filter("patient_id_available"), [*patient, *ORDER], "_rank")
    # Of patients with several images: where they begin. A patient with very many is split as a skewed join.
    several = theirs.groupBy(*patient).agg(F.min("_rank").alias("_first"), F.count("*").alias("n_patient")).filter("n_patient > 1")
    theirs = theirs.join(several, patient, "left").withColumn("p_patient", F.coalesce(F.col("_rank") - F.col("_first"), F.lit(0))).withColumn("n_patient", F.coalesce("n_patient", F.lit(1)))
    alone = {"p_patient": F.lit(0).cast("long"), "n_patient": F.lit(1).cast("long")}
    columns = [*records.columns, "p_cell", "n_cell", "p_patient", "n_patient", "p_dx", "n_dx", "p_site", "n_site", "p_all", "n_all"]
    return theirs.select(*columns).unionByName(placed.filter("not patient_id_available").withColumns(alone).select(*columns))


def _stages() -> list[tuple[str, str, Column, Column]]:
    """Name of the match, column suffix, key of the group, and whether the match may be tried."""
    yes = F.lit(True)
    return [
        (MATCHES[0], "patient", F.col("patient_id"), F.col("patient_id_available")),
        (MATCHES[1], "cell", F.to_json(F.struct("diagnosis", "anatomical_site")), yes),
        (MATCHES[2], "dx", F.col("diagnosis"), yes),
        (MATCHES[3], "site", F.col("anatomical_site"), yes),
        (MATCHES[4], "all", F.lit(""), yes),
    ]


def pick_targets(anchors: DataFrame, placed: DataFrame, strict: bool = False) -> DataFrame:
    """anchors with ``reason`` and the record ``target`` (a struct); those without a match are left out.

    ``anchors`` are rows of ``placed`` with the rank ``k``. A lesion's positions in a group are
    gathered by lesion, so an array holds one lesion's images.
    """
    stages = [s for s in _stages() if not strict or s[0] == MATCHES[1]]
    # All groups of a record in one pass: the reason, the group's key, and the record's place in it.
    groups = F.filter(F.array(*[F.struct(F.lit(name).alias("reason"), key.alias("key"), F.col(f"p_{suffix}").alias("at"), may.alias("may")) for name, suffix, key, may in stages]), lambda g: g["may"])
    lesions = anchors.select("split", "lesion_id").distinct()
    own = placed.join(lesions, ["split", "lesion_id"], "left_semi").select("split", "lesion_id", F.explode(groups).alias("g"))
    own = own.groupBy("split", "lesion_id", "g.reason", "g.key").agg(F.sort_array(F.collect_list("g.at")).alias("own"))
    tries = F.array(*[F.struct(F.lit(i).alias("try"), F.lit(name).alias("reason"), key.alias("key"), F.col(f"n_{suffix}").alias("n"), may.alias("may")) for i, (name, suffix, key, may) in enumerate(stages)])
    tried = anchors.withColumn("t", F.explode(tries)).filter("t.may").select("*", "t.*").drop("t")
    tried = tried.join(own, ["split", "lesion_id", "reason", "key"]).filter(F.col("n") > F.size("own"))
    # The first try that has candidates.
    ids = ["split", "k"]
    first = tried.groupBy(*ids).agg(F.min("try").alias("try"))
    chosen = tried.join(first, [*ids, "try"])
    # The filter above may be checked after this is computed, so the divisor is kept positive.
    rank = F.pmod(F.col("k"), F.greatest(F.col("n") - F.size("own"), F.lit(1)))
    at = F.aggregate("own", rank, lambda acc, e: F.when(e <= acc, acc + 1).otherwise(acc))
    chosen = chosen.withColumn("at", at)
    record = F.struct(*[c for c in placed.columns if not c.startswith(("p_", "n_"))])
    targets = placed.select("split", F.explode(groups).alias("g"), record.alias("target")).select("split", "g.reason", "g.key", "g.at", "target")
    return chosen.join(targets, ["split", "reason", "key", "at"]).select(*anchors.columns, "reason", "target")


def stable_anchors(placed: DataFrame, count: int) -> DataFrame:
    """The first ``count`` records of each split in sort order, numbered by k."""
    return placed.filter(F.col("p_all") < count).withColumn("k", F.col("p_all"))


def changing_pairs(placed: DataFrame, offset: int, count: int, strict: bool = False) -> DataFrame:
    """``count`` changing pairs of each split: anchors in rotation from ``offset``, numbered by ordinal.

    Anchors are tried for k = 0, 1, ... up to four times around; those without a match are
    skipped, but keep their k. A record has a match at every k or at none, so one lap tells
    which records have one, and as few anchors are matched as pairs are wanted.
    """
    lap = F.pmod(F.col("p_all") - offset, F.col("n_all"))
    eligible = placed if not strict else _with_candidates(placed)
    turns = eligible.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: lap + i.cast("long") * F.col("n_all"))))
    # A split's anchors by k: its first ones only, so a bounded sort for each split.
    order = Window.partitionBy("split").orderBy("k")
    wanted = turns.filter(F.col("k") < F.lit(4) * F.col("n_all")).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= count)
    picked = pick_targets(wanted.drop("turn"), placed, strict)
    return picked.withColumn("ordinal", F.row_number().over(Window.partitionBy("split").orderBy("k")) - 1)


def _with_candidates(placed: DataFrame) -> DataFrame:
    """Records whose diagnosis and site another lesion of the split has."""
    cell = ["split", "diagnosis", "anatomical_site"]
    own = placed.groupBy(*cell, "lesion_id").agg(F.count("*").alias("own"))
    return placed.join(own, [*cell, "lesion_id"]).filter("own < n_cell").drop("own")


def synthetic_pairs(records: DataFrame, stable: int, changing: int) -> tuple[DataFrame, DataFrame]:
    """Stable and changing pairs of synthetic records: in the order of their ids, over and over.

    A stable pair is of the record whose turn it is, a changing one of that record and the next
    one of its split; changing pairs go on where the stable ones ended.
    """
    by_id = Window.partitionBy("split").orderBy("image_id")
    placed = records.withColumn("p", F.row_number().over(by_id) - 1).withColumn("n", F.count("*").over(Window.partitionBy("split")))
    record = F.struct(*records.columns).alias("target")
    turns = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("ordinal")
    sizes = placed.groupBy("split").agg(F.first("n").alias("n"))
    first = sizes.select("split", "n", turns(stable)).withColumn("p", F.col("ordinal") % F.col("n")).drop("n")
    second = sizes.select("split", "n", turns(changing)).withColumn("p", (F.col("ordinal") + stable) % F.col("n")).withColumn("q", (F.col("p") + 1) % F.col("n")).drop("n")
    own = placed.drop("n")
    targets = own.select("split", F.col("p").alias("q"), record)
    return own.join(first, ["split", "p"]).select("*", record), own.join(second, ["split", "p"]).join(targets, ["split", "q"])


def pair_rows(pairs: DataFrame, split_label: str, reason: Column, recipe: Column, target_id: Column, target_path: Column, profile: str, name: str = "%s_public_{}_%04d") -> DataFrame:
    """Manifest rows of pairs with an ordinal and a target; diagnosis, site and source are the context's."""
    from pairforge.schema import PAIRS

    values = {
        "pair_id": F.format_string(name.format(split_label), F.col("split"), F.col("ordinal").cast("int")),
        "split": F.col("split"), "source_dataset": F.col("source_dataset"), "pair_label": F.lit(split_label),
        "context_image_id": F.col("image_id"), "target_image_id": target_id, "context_path": F.col("path"), "target_path": target_path,
        "context_checksum": F.col("checksum"), "target_checksum": F.col("target.checksum"),
        "context_width": F.col("width"), "context_height": F.col("height"), "target_width": F.col("target.width"), "target_height": F.col("target.height"),
        "context_patient_id": F.col("patient_id"), "target_patient_id": F.col("target.patient_id"),
        "context_lesion_id": F.col("lesion_id"), "target_lesion_id": F.col("target.lesion_id"),
        "diagnosis": F.col("diagnosis"), "anatomical_site": F.col("anatomical_site"),
        "preprocessing_profile": F.lit(profile), "augmentation_recipe_json": recipe, "pair_construction_reason": reason,
    }
    return pairs.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in PAIRS])
