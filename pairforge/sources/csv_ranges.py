"""CSV files read by many tasks, with line breaks in quoted cells, and rows numbered in the order of the file."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.sinks.files import open_store
from pairforge.sinks.scratch import stored

#: Bytes of a file that a task reads.
RANGE = 32 << 20
#: Bytes that are looked at once for the end of a record.
BLOCK = 1 << 16


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder by name."""
    from pyarrow import fs

    store, name = open_store(path)
    info = store.get_file_info(name)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else []
    listed = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    if not listed:
        raise ValueError(f"no file at {path}")
    return [(f"{scheme}{p}" if scheme else p, size) for p, size in listed]


def record_end(file: pa.NativeFile, at: int, size: int, quoted: bool) -> int:
    """The place after the first line break outside quotes, from ``at`` on; the file's size if there is none."""
    file.seek(at)
    while at < size:
        block = file.read(min(BLOCK, size - at))
        parts = block.split(b'"')
        for i, part in enumerate(parts):
            if not quoted and (n := part.find(b"\n")) >= 0:
                return at + sum(map(len, parts[:i])) + i + n + 1
            if i < len(parts) - 1:
                quoted = not quoted
        at += len(block)
    return size


def header(path: str, size: int) -> list[str]:
    store, name = open_store(path)
    with store.open_input_file(name) as file:
        end = record_end(file, 0, size, False)
        file.seek(0)
        return next(csv.reader(io.StringIO(file.read(end).decode("utf-8-sig"), newline="")), [])


def read(spark: SparkSession, path: str, max_records: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The rows of a CSV file with a header, or of a folder of such files: strings, in the columns of the first header.

    A file is cut into ranges of bytes. First each range's quotes are counted, as their number up
    to a range tells whether it begins within a quoted cell; then a range's task begins at the first
    record that starts in it and reads the last one to its end. Cells are what Python's csv reader
    gives: missing ones are empty, surplus ones dropped, blank lines skipped. A quote must begin a cell or be
    doubled in one that is quoted. ``max_records`` keeps the first rows, by file name and place.
    """
    files = _files(path)
    names = header(*files[0])
    if not names:
        raise ValueError(f"no header in {path}")
    cuts = [(f, i, p, size, a, min(a + range_bytes, size)) for f, (p, size) in enumerate(files) for i, a in enumerate(range(0, max(size, 1), range_bytes))]
    ranges = spark.createDataFrame(cuts, "file int, part int, path string, size long, start long, stop long").repartition(max(1, min(len(cuts), 4096)), "file", "part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, name = open_store(r["path"])
                with store.open_input_file(name) as file:
                    file.seek(r["start"])
                    n, left = 0, r["stop"] - r["start"]
                    while left > 0:
                        block = file.read(min(BLOCK, left))
                        n, left = n + block.count(b'"'), left - len(block)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]], pa.int32()), pa.array([r["part"]], pa.int32()), pa.array([n % 2], pa.int32())], ["file", "part", "odd"])

    odd = {(r.file, r.part): r.odd for r in ranges.mapInArrow(count, "file int, part int, odd int").collect()}  # a row a range
    quoted, begun = {}, False
    for f, i, *_ in cuts:
        begun = False if i == 0 else begun
        quoted[f, i] = begun
        begun ^= bool(odd[f, i])
    width = len(names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, name = open_store(r["path"])
                with store.open_input_file(name) as file:
                    start, size = r["start"], r["size"]
                    if start:  # a record that begins exactly here is this range's
                        file.seek(start - 1)
                        fresh = not r["quoted"] and file.read(1) == b"\n"
                        start = start if fresh else record_end(file, start, size, r["quoted"])
                    if start >= r["stop"]:
                        continue
                    file.seek(r["stop"] - 1)
                    closed = not r["ends"] and file.read(1) == b"\n"
                    stop = r["stop"] if closed else record_end(file, r["stop"], size, r["ends"])
                    file.seek(start)
                    text = file.read(stop - start).decode("utf-8-sig" if not start else "utf-8")
                rows = [x for x in csv.reader(io.StringIO(text, newline="")) if x][0 if r["start"] else 1 :]
                cells = [[*x[:width], *[""] * (width - len(x))] for x in rows]
                columns = [pa.array([r["file"]] * len(rows), pa.int32()), pa.array([r["part"]] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), pa.array(cells, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "part", "at", "cells"])

    known = [(f, i, bool(q), bool(q) ^ bool(odd[f, i])) for (f, i), q in quoted.items()]
    states = spark.createDataFrame(known, "file int, part int, quoted boolean, ends boolean")
    parsed = ranges.join(F.broadcast(states), ["file", "part"]).mapInArrow(parse, "file int, part int, at long, cells array<string>")
    if max_records is not None:
        parsed = stored(parsed, "csv")
        before, starts = 0, []
        for r in sorted(parsed.groupBy("file", "part").agg(F.count("*").alias("n")).collect()):  # a row a range
            starts.append((r.file, r.part, before))
            before += r.n
        placed = spark.createDataFrame(starts, "file int, part int, before long")
        parsed = parsed.join(F.broadcast(placed), ["file", "part"]).filter(F.col("before") + F.col("at") < max_records)
    return parsed.select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)])
