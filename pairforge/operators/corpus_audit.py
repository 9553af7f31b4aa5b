"""An audit of a collection against an evaluation set: evidence of each gate, one verdict a row, and its proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.neardup import hamming_classes

# The columns of the manifest, its splits and review states.
COLUMNS = (
    "image_id",
    "source_dataset",
    "source_record_id",
    "source_uri",
    "license",
    "local_path",
    "sha256_raw",
    "sha256_canonical",
    "phash",
    "modality",
    "diagnosis_label",
    "patient_id",
    "lesion_id",
    "split",
    "ham10000_exclusion_reason",
    "manual_review_status",
)
TRAIN, VAL, AUDIT, EXCLUDED = "pretrain_train", "pretrain_val", "audit_only", "excluded"
NOT_NEEDED, PENDING, CLEARED, OUT = "not_needed", "pending", "cleared", "excluded"

#: Hashes at most REJECT bits apart are of one image; up to REVIEW somebody has to look.
REJECT, REVIEW = 4, 10


def evidence(images: DataFrame, reference: DataFrame) -> DataFrame:
    """images with by_metadata, by_bytes (what of the reference set each meets) and nearest: the least of (distance, id).

    ``images`` has the columns of the manifest up to lesion_id, ``reference`` image_id, lesion_id,
    sha256_raw, sha256_canonical and phash. Both sides meet by equality or as classes of equal hashes; no image meets all of the set.
    """

    def known(name: str, *keys: str) -> DataFrame:
        """(k, name): by value of one of the keys, the least image of the reference set that has it."""
        each = F.explode(F.array_compact(F.array(*keys)))
        return reference.select(each.alias("k"), F.col("image_id").alias("of")).groupBy("k").agg(F.min("of").alias(name))

    named = known("_id", "image_id").withColumnRenamed("k", "source_record_id")
    of_lesion = known("_lesion", "lesion_id").withColumnRenamed("k", "lesion_id")
    found = images.join(named, "source_record_id", "left").join(of_lesion, "lesion_id", "left")
    digests = known("_bytes", "sha256_raw", "sha256_canonical")
    for c in ("sha256_raw", "sha256_canonical"):
        found = found.join(digests.select(F.col("k").alias(c), F.col("_bytes").alias(f"_of_{c}")), c, "left")
    near = hamming_classes(images.select(F.col("image_id").alias("id"), F.col("phash").alias("hash")), reference.select(F.col("image_id").alias("id"), F.col("phash").alias("hash")), REVIEW)
    nearest = near.groupBy("ha").agg(F.min(F.struct("distance", F.col("b_id").alias("of"))).alias("nearest")).withColumnRenamed("ha", "phash")
    found = found.join(nearest, "phash", "left")
    return found.select(*images.columns, F.coalesce("_id", "_lesion").alias("by_metadata"), F.coalesce("_of_sha256_raw", "_of_sha256_canonical").alias("by_bytes"), "nearest")


def _unsourced() -> Column:
    return (F.trim(F.coalesce("license", F.lit(""))) == "") | (F.trim(F.coalesce("source_dataset", F.lit(""))) == "")


def manifest(images: DataFrame, reference: DataFrame, validation: float = 0.05, cleared: DataFrame | None = None) -> DataFrame:
    """The manifest: COLUMNS and ``proof``, one row an image. The first gate that rejects it gives the reason.

    Gates in order: named like the reference set, equal bytes, near hash, no licence or source,
    no hash to look at, then doubtful nearness, which waits for review unless ``cleared`` (image_id)
    lists it. Images that pass are for validation with the given share, by a hash of their ids; of
    copies of one another (raw bytes) all are in the same split.
    """
    rows = evidence(images, reference)
    unsourced = _unsourced()
    far, of = F.col("nearest.distance"), F.col("nearest.of")
    named = F.col("by_metadata").isNotNull()
    if cleared is not None:
        rows = rows.join(cleared.select("image_id", F.lit(True).alias("_cleared")).distinct(), "image_id", "left")
    looked = F.coalesce(F.col("_cleared"), F.lit(False)) if cleared is not None else F.lit(False)
    gates: list[tuple[Column, str, Column]] = [
        (named, "source_metadata", F.col("by_metadata")), (F.col("by_bytes").isNotNull(), "exact_hash", F.col("by_bytes")),
        (far <= REJECT, "perceptual_hash", F.concat_ws(":", of, far.cast("string"))), (unsourced, "missing_provenance", F.lit(None).cast("string")),
        (F.col("phash").isNull() | F.col("sha256_raw").isNull(), "not_hashed", F.lit(None).cast("string")),
        ((far <= REVIEW) & ~looked, "ambiguous_near_duplicate", F.concat_ws(":", of, far.cast("string"))),
    ]
    reason, proof = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, what in reversed(gates):
        reason, proof = F.when(test, name).otherwise(reason), F.when(test, what).otherwise(proof)
    doubtful = F.col("ham10000_exclusion_reason") == "ambiguous_near_duplicate"
    share = F.conv(F.substring(F.md5(F.coalesce("sha256_raw", "image_id")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    out = rows.withColumn("ham10000_exclusion_reason", reason).withColumn("proof", F.when((far <= REVIEW) & looked & reason.isNull(), F.concat_ws(":", of, far.cast("string"))).otherwise(proof))
    out = out.withColumn("split", F.when(doubtful, AUDIT).when(F.col("ham10000_exclusion_reason").isNotNull(), EXCLUDED).when(share < validation, VAL).otherwise(TRAIN))
    out = out.withColumn("manual_review_status", F.when(doubtful, PENDING).when(F.col("ham10000_exclusion_reason").isNotNull(), OUT).when(F.col("proof").isNotNull(), CLEARED).otherwise(NOT_NEEDED))
    return out.select(*COLUMNS, "proof")


def violations(audited: DataFrame, reference: DataFrame) -> DataFrame:
    """(gate, image_id): accepted rows that the evidence speaks against; an audit that has any must fail."""
    accepted = audited.filter(F.col("split").isin(TRAIN, VAL)).select(*COLUMNS[:13], "manual_review_status")
    rows = evidence(accepted, reference)
    tests = {
        "source_metadata": F.col("by_metadata").isNotNull(), "exact_hash": F.col("by_bytes").isNotNull(), "perceptual_hash": F.col("nearest.distance") <= REJECT,
        "ambiguous_near_duplicate": (F.col("nearest.distance") <= REVIEW) & (F.col("manual_review_status") != CLEARED),
        "missing_provenance": _unsourced(),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()])))
    return rows.select(broken.alias("gate"), "image_id")


def report(audited: DataFrame) -> DataFrame:
    """(source_dataset, split, reason, n): the distribution of sources, verdicts and reasons."""
    return audited.groupBy("source_dataset", "split", F.col("ham10000_exclusion_reason").alias("reason")).agg(F.count("*").alias("n"))
