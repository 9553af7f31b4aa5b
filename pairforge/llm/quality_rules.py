"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import sliced

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits on ratio = bytes / compressed bytes.

    ``whole``: (below this many bytes, least ratio, greatest ratio) for whole documents, in
    rising order; the longer a text, the more a compressor finds in it. ``mean`` limits the mean
    ratio over full chunks of ``chunk_bytes``, and ``most`` the greatest; what is left after the
    last full chunk has the limits of a whole document of its length, ``slack`` times as wide. A
    document outside any limit is rejected: above, it repeats itself; below, it is noise such as
    encoded data. The defaults were fitted on half of the labelled documents; see the README.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.80, 1.45),
        (181, 0.95, 1.55),
        (256, 1.00, 1.70),
        (362, 1.10, 1.80),
        (512, 1.20, 1.92),
        (724, 1.25, 1.92),
        (1024, 1.35, 2.00),
        (1448, 1.45, 2.06),
        (2048, 1.50, 2.12),
        (2896, 1.60, 2.19),
        (4096, 1.65, 2.26),
        (5793, 1.70, 2.34),
        (8192, 1.75, 2.40),
        (16384, 1.80, 2.50),
        (65536, 1.85, 2.65),
        (float("inf"), 1.90, 3.00),
    )
    chunk_bytes: int = 2048
    mean: tuple[float, float] = (1.35, 2.17)
    most: float = 2.60
    slack: float = 1.25

    def limits(self, n: int) -> tuple[float, float]:
        return next((lo, hi) for below, lo, hi in self.whole if n < below)


class Rules:
    """The measures and the verdict of one text."""

    def __init__(self, bands: Bands) -> None:
        import zstandard

        self.bands = bands
        self.squeeze = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False).compress

    def base(self, text: str, raw: bytes) -> tuple[int, int, int, int, int]:
        words = raw.split()
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        return (
            len(words),
            len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)),
            repeated(words),
        )

    def ratios(self, raw: bytes) -> tuple[float, list[float], float | None]:
        """Of the whole, of each full chunk, and of what is left after the last of these, if anything is."""
        step = self.bands.chunk_bytes
        full = len(raw) // step * step
        ratio = lambda part: len(part) / len(self.squeeze(part)) if part else 1.0
        chunks = [ratio(raw[i : i + step]) for i in range(0, full, step)]
        return ratio(raw), chunks, ratio(raw[full:]) if full and full < len(raw) else None

    def in_bands(self, size: int, ratios: tuple[float, list[float], float | None]) -> bool:
        whole, chunks, tail = ratios
        lo, hi = self.bands.limits(size)
        if not lo <= whole <= hi:
            return False
        if chunks and not (self.bands.mean[0] <= sum(chunks) / len(chunks) <= self.bands.mean[1] and max(chunks) <= self.bands.most):
            return False
        lo, hi = self.bands.limits(size % self.bands.chunk_bytes)
        return tail is None or lo / self.bands.slack <= tail <= hi * self.bands.slack

    def judge(self, text: str | None) -> tuple[int, int, int, int, int, bool, bool, float, float]:
        text = text or ""
        raw = text.encode()
        base = self.base(text, raw)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        ratios = self.ratios(raw)
        return *base, failed, not failed and self.in_bands(len(raw), ratios), ratios[0], max(ratios[1], default=ratios[0])


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # Exact names of windows by doubling: of 2, 4 and 8 words.
    for step in (1, 2, 4):
        pair = at[:-step] * (int(at.max()) + 1) + at[step:]
        at = np.unique(pair, return_inverse=True)[1]
        if step < 4 and len(at) == 0:
            return 0
    twice = np.bincount(at)[at] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FLAGS = ("base_failed", "kept")
RATIOS = ("whole_ratio", "top_chunk_ratio")


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id with the base counts, base_failed, kept and two compression ratios of each row.

    A null text counts as empty: no words, so base_failed. Repeated rows are judged each, null
    ids stay, other columns are ignored, an empty table gives no rows. Whole texts are measured.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(bands)
        for b in sliced(batches):
            found = list(zip(*map(rules.judge, b.column(1).to_pylist()), strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], ["doc_id", *STATS, *FLAGS, *RATIOS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in STATS), *(f"{c} boolean" for c in FLAGS), *(f"{c} double" for c in RATIOS)])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows, with all their columns, that judge() keeps."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(bands)
        for b in sliced(batches):
            yield b.filter(pa.array([rules.judge(t)[6] for t in b.column(at).to_pylist()], pa.bool_()))

    # By place, as mapInArrow takes a name with a dot for a field.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
