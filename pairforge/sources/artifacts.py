"""Manifests, embeddings, metrics documents and archives of earlier stages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.text import label_int
from pairforge.functions.vectors import normalised
from pairforge.schema import EMBEDDINGS, PAIRS


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Pairs with the manifest's schema and label_int; a split is a partition, so others are not read."""
    rows = spark.read.schema(PAIRS).parquet(path)
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    return rows.withColumn("label_int", label_int(F.col("pair_label")))


def read_vectors(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    """(image_id, vector) of one model, each vector of length 1; a near-zero one is left as it is."""
    rows = spark.read.schema(EMBEDDINGS).parquet(path)
    if model_id is not None:
        rows = rows.filter(F.col("model_id") == model_id)
    return rows.select("image_id", normalised(F.col("vector"), "keep").alias("vector"))


def import_npz(spark: SparkSession, path: str, ids: str = "image_ids", matrix: str = "embeddings") -> DataFrame:
    """(image_id, vector) of a NumPy archive, which is read on the driver. As many ids as rows are needed."""
    import numpy as np

    with np.load(path, allow_pickle=False) as data:
        names, rows = data[ids], data[matrix].astype(np.float32)
    if len(names) != len(rows):
        raise ValueError(f"{len(names)} ids for {len(rows)} vectors in {path}")
    table = pa.table({"image_id": pa.array([str(n) for n in names]), "vector": pa.array(list(rows), pa.list_(pa.float32()))})
    return spark.createDataFrame(table)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as one row; anything but an object is an error."""
    text = spark.read.text(path, wholetext=True)
    rows = spark.read.json(path, multiLine=True)
    if text.filter(~F.startswith(F.ltrim("value"), F.lit("{"))).limit(1).count():
        raise ValueError(f"not a JSON object: {path}")
    return rows


def read_runs(spark: SparkSession, root: str, name: str = "metrics.json") -> DataFrame:
    """(run_id, json) of every run below root that has metrics; the folder names the run."""
    text = spark.read.text(f"{root}/*/{name}", wholetext=True)
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"), F.col("value").alias("json"))


def missing_runs(found: DataFrame, expected: list[str]) -> list[str]:
    """Of the runs expected, those that read_runs() did not find."""
    there = {r[0] for r in found.select("run_id").filter(F.col("run_id").isin(expected)).collect()}
    return [run for run in expected if run not in there]
