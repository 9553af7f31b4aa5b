"""What a JPEG file says of itself: size and orientation, from its segments."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, size) of each segment up to the compressed data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:  # fill bytes and segments of no length
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA) or size < 2:
            return
        yield marker, at + 4, size - 2
        at += 2 + size


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header, wherever it stands and whatever the coding; None if there is none."""
    if data[:2] != b"\xff\xd8":
        return None
    for marker, at, size in _segments(data):
        # Frames are C0 to CF but for tables of codes, an extension and arithmetic conditions.
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and size >= 6 and at + 5 <= len(data):
            height, width = struct.unpack_from(">HH", data, at + 1)
            return (width, height) if width and height else None
    return None


def jpeg_orientation(data: bytes) -> int:
    """The orientation of the Exif segment, 1 to 8; 1 if it is not told."""
    if data[:2] != b"\xff\xd8":
        return 1
    for marker, at, size in _segments(data):
        if marker != 0xE1 or data[at : at + 6] != b"Exif\0\0" or size < 14:
            continue
        tiff = data[at + 6 : at + size]
        order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        if order is None:
            return 1
        (first,) = struct.unpack_from(f"{order}I", tiff, 4)
        if first + 2 > len(tiff):
            return 1
        (count,) = struct.unpack_from(f"{order}H", tiff, first)
        for entry in range(first + 2, min(first + 2 + 12 * count, len(tiff) - 11), 12):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", tiff, entry)
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else 1
        return 1
    return 1


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _sizes(content: pd.Series) -> pd.DataFrame:
    found = [jpeg_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int64"), "height": pd.array([f and f[1] for f in found], "Int64")})


@F.pandas_udf(T.IntegerType())
def _orientations(content: pd.Series) -> pd.Series:
    return pd.Series([jpeg_orientation(bytes(c)) if c is not None else 1 for c in content], dtype="int32")


def _jpeg(content: Column) -> Column:
    """The content of JPEG files, null for others, so that those alone go to Python."""
    return F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", content)


def jpeg_sizes(content: Column) -> Column:
    return _sizes(_jpeg(content))


def orientations(content: Column) -> Column:
    return _orientations(_jpeg(content))
