"""Metadata tables and image listings, normalised into records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.headers import jpeg_sizes
from pairforge.functions.text import first_filled
from pairforge.schema import ALIASES, NO_DIAGNOSIS, NO_LESION, NO_PATIENT, NO_SITE, RECORDS, SYNTHETIC_DIAGNOSES, SYNTHETIC_SITES
from pairforge.sources import csv_ranges
from pairforge.sources.chosen import read_chosen


def read_csv(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """A CSV with a header, all strings; empty and missing cells are empty strings. Surplus cells are dropped.

    Quoted cells may hold line breaks; a file is read by as many tasks as it has ranges all the
    same. ``max_records`` keeps the first rows, of a folder by file name.
    """
    rows = csv_ranges.read(spark, path, max_records)
    if not rows.limit(1).count():
        raise ValueError(f"no rows in {path}")
    return rows


def _field(rows: DataFrame, field: str) -> Column:
    """The first filled of a field's aliases, whatever the header's case and padding; null if there is none."""
    by_name: dict[str, str] = {}
    for name in rows.columns:
        by_name.setdefault(name.strip().lower(), name)
    found = [F.col(f"`{by_name[a]}`") for a in ALIASES[field] if a in by_name]
    return first_filled(found) if found else F.lit(None).cast("string")


def fields(rows: DataFrame) -> DataFrame:
    """The raw fields of each row; a row without an image id fails the query."""
    image = F.coalesce(_field(rows, "image_id"), F.raise_error(F.lit("a metadata row has no image id")).cast("string"))
    return rows.select(image.alias("image_id"), *[_field(rows, f).alias(f) for f in ALIASES if f != "image_id"])


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Files under the roots, in their order: root, path and file. No file is opened."""
    out = None
    for i, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root)
        part = files.select(F.lit(i).alias("root"), "path", F.element_at(F.split("path", "/"), -1).alias("file"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no image roots")
    return out


def resolve(ids: DataFrame, files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """(image_id, path): the first file of each id, by root, then by extension.

    An id that has a suffix is a file's name; another is tried with each extension.
    """
    endings = F.array(*[F.lit("." + e.lstrip(".").lower()) for e in extensions])
    named = F.col("image_id").rlike(r"[^/.][^/]*\.[^./]+$")
    tries = F.when(named, F.array(F.struct(F.lit(0).alias("ext"), F.col("image_id").alias("file")))).otherwise(F.transform(endings, lambda e, i: F.struct(i.alias("ext"), F.concat(F.col("image_id"), e).alias("file"))))
    wanted = ids.select("image_id").distinct().select("image_id", F.explode(tries).alias("t")).select("image_id", "t.*")
    best = F.min_by("path", F.struct("root", "ext"))
    return wanted.join(files, "file").groupBy("image_id").agg(best.alias("path"))


def probe(files: DataFrame) -> DataFrame:
    """files (with path and content) plus checksum, width and height, from the bytes alone; null sizes where no header is found.

    PNG, GIF and BMP keep their sizes at fixed places; a JPEG's segments are walked to its frame header.
    """
    head = F.substring("content", 1, 32)
    digits = F.hex(head)

    def number(start: int, count: int, swap: bool = False) -> Column:
        part = F.substring(digits, start * 2 + 1, count * 2)
        if swap:
            part = F.concat(*[F.substring(digits, (start + i) * 2 + 1, 2) for i in reversed(range(count))])
        return F.conv(part, 16, 10).cast("long")

    frame = jpeg_sizes(F.col("content"))
    png, gif, bmp = F.startswith(digits, F.lit("89504E47")), F.startswith(digits, F.lit("474946")), F.startswith(digits, F.lit("424D"))
    width = F.when(png, number(16, 4)).when(gif, number(6, 2, True)).when(bmp, number(18, 4, True)).otherwise(frame["width"])
    height = F.when(png, number(20, 4)).when(gif, number(8, 2, True)).when(bmp, number(22, 4, True)).otherwise(frame["height"])
    return files.select("*", F.sha2("content", 256).alias("checksum"), width.alias("width"), height.alias("height"))


def normalise(raw: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Records of raw fields and found images (image_id, path, checksum, width, height).

    A missing lesion is named after its image and a missing patient after its lesion. An image
    that is absent has no path, one that cannot be read keeps its path; both count as not found.
    """
    lesion = F.coalesce("lesion_id", F.concat(F.lit(NO_LESION), "image_id"))
    joined = raw.join(found, "image_id", "left")
    readable = F.col("path").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    values = {
        "image_id": F.col("image_id"), "lesion_id": lesion, "lesion_id_available": F.col("lesion_id").isNotNull(),
        "patient_id": F.coalesce("patient_id", F.concat(F.lit(NO_PATIENT), lesion)), "patient_id_available": F.col("patient_id").isNotNull(),
        "diagnosis": F.coalesce("diagnosis", F.lit(NO_DIAGNOSIS)), "anatomical_site": F.coalesce("anatomical_site", F.lit(NO_SITE)),
        "source_dataset": F.lit(source), "path": F.coalesce("path", F.lit("")), "image_found": readable,
        "checksum": F.when(readable, F.col("checksum")).otherwise(""),
        "width": F.when(readable, F.col("width")).otherwise(0), "height": F.when(readable, F.col("height")).otherwise(0),
    }
    return joined.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RECORDS])


def load_records(spark: SparkSession, csv: str, roots: Sequence[str], extensions: Sequence[str], source: str, max_records: int | None = None) -> DataFrame:
    """Records of a metadata table and its image folders. Bytes are read of chosen files only, and to their end."""
    raw = fields(read_csv(spark, csv, max_records))
    chosen = resolve(raw, listing(spark, roots), extensions)
    # An image whose body is broken has no size, as one without a header.
    sizes = probe(read_chosen(chosen)).drop("content")
    sizes = sizes.withColumns({c: F.when(F.col("whole"), F.col(c)) for c in ("width", "height")}).drop("whole")
    return normalise(raw, chosen.join(sizes, "path"), source)


def ids_in_listing(files: DataFrame, pattern: str = r"ISIC_\w+") -> DataFrame:
    """Distinct ids among file names."""
    return files.select(F.regexp_extract("file", f"({pattern})\\.[^.]+$", 1).alias("image_id")).filter("image_id <> ''").distinct()


def synthetic_records(spark: SparkSession, lesions_per_split: int, source: str = "synthetic") -> DataFrame:
    """Deterministic records: {split}_base_000 and on, diagnoses and sites in turn."""
    i = F.col("i")
    splits = F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test"))).alias("split")
    rows = spark.range(lesions_per_split).select(F.col("id").alias("i"), splits)
    name = F.format_string("%s_base_%03d", "split", i)
    return rows.select(
        "split", name.alias("image_id"), F.format_string("%s_lesion_%03d", "split", i).alias("lesion_id"), F.lit(True).alias("lesion_id_available"),
        F.format_string("%s_patient_%03d", "split", i).alias("patient_id"), F.lit(True).alias("patient_id_available"),
        F.element_at(F.array(*map(F.lit, SYNTHETIC_DIAGNOSES)), (i % 2 + 1).cast("int")).alias("diagnosis"),
        F.element_at(F.array(*map(F.lit, SYNTHETIC_SITES)), (i % 3 + 1).cast("int")).alias("anatomical_site"),
        F.lit(source).alias("source_dataset"), F.lit("").alias("path"), F.lit(True).alias("image_found"), F.sha2(name, 256).alias("checksum"),
        F.lit(64).cast("long").alias("width"), F.lit(64).cast("long").alias("height"),
    )
