"""Decoded images: files by path, members of archives, and deterministic synthetic ones."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import pixels
from pairforge.functions.headers import orientations
from pairforge.sinks.files import open_store, put


def same_path(path: Column) -> Column:
    """A local path in one form; sources write its slashes in different numbers."""
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"^/+", "/")


def images_in(spark: SparkSession, folders: Sequence[str], oriented: bool = False) -> DataFrame:
    """(path, image, orientation) of the images below the folders; what cannot be decoded is left out.

    Spark's image source decodes in the JVM. With ``oriented``, JPEG files are read once more for
    the orientation that they declare, which is 1 otherwise.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(folders))
    rows = rows.select(same_path(F.col("image.origin")).alias("path"), "image")
    if not oriented:
        return rows.withColumn("orientation", F.lit(1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(list(folders))
    said = files.select(same_path(F.col("path")).alias("path"), orientations(F.col("content")).alias("orientation")).filter("orientation > 1")
    return rows.join(said, "path", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1)))


def pictures(ids: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, image, orientation) of ids (image_id, path)."""
    return ids.select("image_id", same_path(F.col("path")).alias("path")).join(images, "path").select("image_id", "image", "orientation")


def perceptual_hashes(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(id, hash) of images (key, image): the collection side of a near-duplicate join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b[key], "hash": [pixels.perceptual_hash(pixels.from_row(x)) for x in b["image"]]})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "image").mapInPandas(run, f"id {kind}, hash long")


def hash_families(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(id, perceptual, difference, wavelet, average) of images (key, image), each decoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [pixels.from_row(x) for x in b["image"]]
            yield pd.DataFrame({"id": b[key]} | {name: [make(r) for r in rows] for name, make in pixels.HASHES.items()})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "image").mapInPandas(run, f"id {kind}, {', '.join(f'{name} long' for name in pixels.HASHES)}")


def archive_members(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(archive, position, member) of the images in ZIP archives, in the order of their directories, which alone are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["path"]:
                store, name = open_store(archive)
                with store.open_input_file(name) as file, zipfile.ZipFile(file) as z:
                    names = [m for m in z.namelist() if m.rpartition(".")[2].lower() in extensions]
                yield pd.DataFrame({"archive": [archive] * len(names), "position": range(len(names)), "member": names})

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "archive string, position long, member string")


def extract(members: DataFrame, folder: str) -> DataFrame:
    """(archive, position, member, path) of members, each read by itself and written below folder.

    Members are dealt over all tasks, whatever archive they are of; a task opens an archive once
    for those it has. A member that cannot be read has a null path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = []
            for archive, rows in b.groupby("archive", sort=False):
                store, name = open_store(archive)
                with store.open_input_file(name) as file, zipfile.ZipFile(file) as z:
                    for key, position, member in zip(rows["key"], rows["position"], rows["member"], strict=True):
                        try:
                            data = z.read(member)
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                            paths.append((archive, position, member, None))
                            continue
                        paths.append((archive, position, member, put(f"{folder}/{key}.{member.rpartition('.')[2].lower()}", data)))
            yield pd.DataFrame(paths, columns=["archive", "position", "member", "path"])

    keyed = members.select("archive", "position", "member", F.sha2(F.concat_ws("\n", "archive", "member"), 256).alias("key"))
    return keyed.repartition(F.col("key")).mapInPandas(run, "archive string, position long, member string, path string")


def coverage(members: DataFrame, hashed: DataFrame) -> DataFrame:
    """By archive: its image members, and how many of them were hashed. ``hashed`` has archive and member."""
    done = hashed.select("archive", "member", F.lit(1).alias("done"))
    both = members.join(done, ["archive", "member"], "left")
    return both.groupBy("archive").agg(F.count("*").alias("members"), F.count("done").alias("hashed"))


def synthetic_picture(size: int, index: int) -> np.ndarray:
    """Skin with a lesion whose place, shape and colour follow from its number."""
    rng = np.random.default_rng(index)
    y, x = np.mgrid[0:size, 0:size] / size
    skin = np.array([205 + index % 17, 165 + index % 13, 145 + index % 11], float)
    image = skin + rng.normal(0.0, 2.0, (size, size, 3))
    cx, cy, wide, tall = 0.4 + 0.2 * rng.random(), 0.4 + 0.2 * rng.random(), 0.12 + 0.12 * rng.random(), 0.1 + 0.12 * rng.random()
    for shrink, colour in ((1.0, (120, 75, 60)), (0.6, (85 + index % 19, 50, 45))):
        inside = ((x - cx) / (wide * shrink)) ** 2 + ((y - cy) / (tall * shrink)) ** 2 < 1
        image[inside] = colour
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def write_synthetic(records: DataFrame, folder: str, size: int) -> DataFrame:
    """records with a picture each, written below folder: path, checksum, width and height are its own."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, number in enumerate(b["number"]):
                data = pixels.png(synthetic_picture(size, int(number)))
                b.loc[b.index[i], ["path", "checksum"]] = [put(f"{folder}/{b['image_id'].iloc[i]}.png", data), hashlib.sha256(data).hexdigest()]
            yield b.assign(width=size, height=size).drop(columns="number")

    numbered = records.withColumn("number", F.pmod(F.xxhash64("image_id"), F.lit(1 << 31)))
    return numbered.mapInPandas(run, records.schema)
