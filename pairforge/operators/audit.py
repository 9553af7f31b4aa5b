"""Audits of records and manifests: coverage, counts, cross-tables, leakage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.operators.checks import duplicate_ids, split_overlap
from pairforge.schema import LABELS, NO_DIAGNOSIS, NO_SITE, SPLITS


def coverage(records: DataFrame) -> DataFrame:
    """One row of conditional counts."""
    tests: dict[str, Column] = {
        "lesion_id_present": F.col("lesion_id_available"),
        "patient_id_present": F.col("patient_id_available"),
        "diagnosis_present": F.col("diagnosis") != NO_DIAGNOSIS,
        "anatomical_site_present": F.col("anatomical_site") != NO_SITE,
        "found": F.col("image_found"),
        "missing": ~F.col("image_found"),
    }
    return records.agg(F.count("*").alias("records"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def duplicate_checksums(records: DataFrame) -> DataFrame:
    """Checksums that two or more found images share."""
    return duplicate_ids(records.filter("image_found and checksum <> ''"), "checksum")


def frequencies(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def label_by_split(pairs: DataFrame) -> DataFrame:
    """Pairs of each split and label, with zeros."""
    table = pairs.groupBy("split").pivot("pair_label", list(LABELS)).agg(F.count(F.lit(1)))
    return table.na.fill(0, list(LABELS))


def first_per_label(pairs: DataFrame, count: int = 5) -> DataFrame:
    """The first pairs of each split and label by pair_id, for human review."""
    order = Window.partitionBy("split", "pair_label").orderBy("pair_id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)


def last_path(rows: DataFrame, key: str, path: str, ordinal: str) -> DataFrame:
    """One row for each key, with the path of its greatest ordinal: the last one written."""
    return rows.groupBy(key).agg(F.max_by(path, ordinal).alias(path))


def images_of(pairs: DataFrame) -> DataFrame:
    """(image_id, path) of all contexts and targets; of an id with two paths the last, in pair order, targets after contexts."""
    sides = F.array(
        F.struct(F.col("context_image_id").alias("image_id"), F.col("context_path").alias("path"), F.lit(0).alias("side")),
        F.struct(F.col("target_image_id").alias("image_id"), F.col("target_path").alias("path"), F.lit(1).alias("side")),
    )
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    rank = F.struct(order.alias("s"), (F.col("pair_label") == "changing").alias("l"), F.col("pair_id").alias("p"), F.col("x.side").alias("side"))
    both = pairs.select("split", "pair_label", "pair_id", F.explode(sides).alias("x")).select("x.image_id", "x.path", rank.alias("ordinal"))
    return last_path(both, "image_id", "path", "ordinal")


# Sentences of the leakage note.
NOTE = {
    "always": "Splits are generated at patient ID level when patient IDs are available and otherwise at lesion ID level. "
    "Stable nuisance variants are generated only after split assignment.",
    "no_patients": "Patient identifiers are unavailable in the metadata, so the main leakage boundary is lesion ID.",
    "no_lesions": "Some rows lack lesion IDs and use image-level fallback groups; results from those rows must be treated as exploratory.",
    "duplicates": "Duplicate image IDs are present and manifest generation refuses to continue until they are resolved.",
    "missing": "Some metadata rows do not have local images; audit is inspectable, but manifest generation requires complete local image availability.",
}


def leakage_note(records: int | Column, lesions: Column, patients: Column, duplicates: Column, missing: Column) -> Column:
    return F.concat_ws(
        " ", F.lit(NOTE["always"]), F.when(patients == 0, NOTE["no_patients"]), F.when(lesions < records, NOTE["no_lesions"]),
        F.when(duplicates > 0, NOTE["duplicates"]), F.when(missing > 0, NOTE["missing"]),
    )


def leakage(pairs: DataFrame) -> DataFrame:
    """(side, left_split, right_split, value): every lesion and patient that two splits have; the document lists the first ones."""
    found = None
    for side in ("lesion", "patient"):
        own = split_overlap(pairs, f"context_{side}_id", f"target_{side}_id").select(F.lit(side).alias("side"), "left_split", "right_split", "value")
        found = own if found is None else found.unionByName(own)
    return found


def value_counts(records: DataFrame) -> DataFrame:
    """(field, value, n): how often every diagnosis and site comes; the document lists the most frequent ones."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("diagnosis", "anatomical_site")])
    return records.select(F.explode(fields).alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("n"))


def audit(records: DataFrame, pairs: DataFrame | None = None, samples: int = 10, duplicates: int = 20) -> dict[str, Any]:
    """The audit as a document: every list in it is bounded, every count is an aggregate."""
    row = coverage(records).first().asDict()
    unreadable = records.filter("not image_found and path <> ''")
    missing = records.filter("not image_found and path = ''")
    twice = duplicate_ids(records, "image_id")
    counts = {"duplicates": twice.count(), "missing": missing.count(), "unreadable": unreadable.count()}
    ids = lambda df, n: [r[0] for r in df.select("image_id").orderBy("image_id").limit(n).collect()]
    note = records.sparkSession.range(1).select(leakage_note(row["records"], F.lit(row["lesion_id_present"]), F.lit(row["patient_id_present"]), F.lit(counts["duplicates"]), F.lit(counts["missing"]))).first()[0]
    most = 10_000

    def table(df: DataFrame, key: str) -> dict[str, int]:
        """Counts by value; of more than ``most`` values the rarer ones are one entry, so that counts add up to all rows."""
        counted = frequencies(df, key)
        shown = {r[0]: r["n"] for r in counted.orderBy(F.desc("n"), key).limit(most).collect()}
        values, rows = counted.agg(F.count("*"), F.sum("n")).first()
        return shown if values <= most else shown | {f"({values - most} other values)": rows - sum(shown.values())}

    found: dict[str, Any] = {
        "normalized_records": row["records"],
        "image_availability": {"found": row["found"], "missing": counts["missing"], "unreadable": counts["unreadable"], "missing_sample": ids(missing, samples), "unreadable_sample": ids(unreadable, samples)},
        "metadata_coverage": {k: v for k, v in row.items() if k.endswith("_present")},
        "duplicate_probes": {"duplicate_image_ids": ids(twice, duplicates), "duplicate_image_id_count": counts["duplicates"], "duplicate_checksum_count": duplicate_checksums(records).count()},
        "diagnosis_counts": table(records, "diagnosis"),
        "anatomical_site_counts": table(records, "anatomical_site"),
        "leakage_risk_note": note,
    }
    if pairs is not None:
        labels = {r["split"]: {x: r[x] for x in LABELS} for r in label_by_split(pairs).collect()}
        found["pair_count"] = pairs.count()
        found["labels_by_split"] = {s: labels.get(s, dict.fromkeys(LABELS, 0)) for s in SPLITS}
        found["leakage_probes"] = {f"{side}_overlap": {f"{a}_{b}": [] for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]} for side in ("lesion", "patient")}
        found["leakage_probes"]["overlap_counts"] = {}
        for side in ("lesion", "patient"):
            overlap = split_overlap(pairs, f"context_{side}_id", f"target_{side}_id")
            sizes = {f"{r.left_split}_{r.right_split}": r.n for r in overlap.groupBy("left_split", "right_split").agg(F.count("*").alias("n")).collect()}
            probes = found["leakage_probes"][f"{side}_overlap"]
            found["leakage_probes"]["overlap_counts"][side] = {pair: sizes.get(pair, 0) for pair in probes}
            # Of each pair of splits the first values; the counts tell if there are more.
            first = overlap.withColumn("place", F.row_number().over(Window.partitionBy("left_split", "right_split").orderBy("value"))).filter("place <= 1000")
            for r in first.orderBy("value").collect():
                probes[f"{r.left_split}_{r.right_split}"].append(r.value)
        for name, key in (("source_counts_by_split", "source_dataset"), ("diagnosis_counts_by_split", "diagnosis")):
            by: dict[str, dict[str, int]] = {s: {} for s in SPLITS}
            for r in frequencies(pairs, "split", key).collect():
                by[r["split"]][r[key]] = r["n"]
            found["leakage_probes"][name] = by
    return found
