"""Table schemas and fixed values of the pair datasets."""

from __future__ import annotations

from pyspark.sql import types as T

SPLITS = ("train", "val", "test")
LABELS = ("stable", "changing")


_TEXT, _LONG, _FLAG = T.StringType(), T.LongType(), T.BooleanType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# The columns of normalised image records.
RECORDS = _struct([
    ("image_id", _TEXT),
    ("lesion_id", _TEXT),
    ("lesion_id_available", _FLAG),
    ("patient_id", _TEXT),
    ("patient_id_available", _FLAG),
    ("diagnosis", _TEXT),
    ("anatomical_site", _TEXT),
    ("source_dataset", _TEXT),
    ("path", _TEXT),
    ("image_found", _FLAG),
    ("checksum", _TEXT),
    ("width", _LONG),
    ("height", _LONG),
])

# The columns of the pairs of a manifest.
PAIRS = _struct([
    ("pair_id", _TEXT),
    ("split", _TEXT),
    ("source_dataset", _TEXT),
    ("pair_label", _TEXT),
    ("context_image_id", _TEXT),
    ("target_image_id", _TEXT),
    ("context_path", _TEXT),
    ("target_path", _TEXT),
    ("context_checksum", _TEXT),
    ("target_checksum", _TEXT),
    ("context_width", _LONG),
    ("context_height", _LONG),
    ("target_width", _LONG),
    ("target_height", _LONG),
    ("context_patient_id", _TEXT),
    ("target_patient_id", _TEXT),
    ("context_lesion_id", _TEXT),
    ("target_lesion_id", _TEXT),
    ("diagnosis", _TEXT),
    ("anatomical_site", _TEXT),
    ("preprocessing_profile", _TEXT),
    ("augmentation_recipe_json", _TEXT),
    ("pair_construction_reason", _TEXT),
])

# The columns of embeddings, one row for each image and model.
EMBEDDINGS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("image_id", "path", "model_id", "model_name", "model_kind", "feature_type")]
    + [T.StructField("dimension", _LONG), T.StructField("preprocessing_profile", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]
)

# Header names of each field, in the order in which they are tried.
ALIASES = {
    "image_id": ("image_id", "isic_id", "image", "imageid"),
    "lesion_id": ("lesion_id", "lesion", "lesionid"),
    "patient_id": ("patient_id", "patient", "subject_id", "participant_id", "patient_identifier"),
    "diagnosis": ("dx", "diagnosis", "diagnosis_label", "class", "label"),
    "anatomical_site": ("localization", "anatom_site_general", "anatomical_site", "site"),
}

# What stands for a missing field.
NO_LESION, NO_PATIENT, NO_DIAGNOSIS, NO_SITE = "missing_lesion::", "missing_patient::", "unknown_diagnosis", "unknown_site"

# Why a changing pair was matched, in the order in which matches are tried.
MATCHES = (
    "different_lesion_same_patient",
    "different_lesion_same_diagnosis_and_site",
    "different_lesion_same_diagnosis",
    "different_lesion_same_site",
    "different_lesion_unmatched_fallback",
)

# Diagnoses and sites of synthetic records, in turn, and why their pairs were made.
SYNTHETIC_DIAGNOSES, SYNTHETIC_SITES = ("synthetic_proxy_type_a", "synthetic_proxy_type_b"), ("torso", "arm", "leg")
SYNTHETIC_STABLE, SYNTHETIC_CHANGING = "same_lesion_mild_nuisance_after_split", "different_synthetic_lesion_matched_within_split"

# What is added to the run's seed by each use of randomness.
SEED_OFFSETS = {
    "pairs": 1009, "pixel": 11, "ssim": 23, "embedding": 101, "linear": 307, "mlp_init": 401, "mlp_batches": 409,
    "train": 701, "val": 709, "test": 719,
}
