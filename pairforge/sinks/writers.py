"""Writers of tables, documents and bundles."""

from __future__ import annotations

import html
import json
import platform
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict
from datetime import UTC, datetime
from importlib.metadata import version
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.audit import first_per_label
from pairforge.sinks.files import copy, put

# Columns of the review subset.
REVIEW = (
    "split", "pair_label", "pair_id", "context_image_id", "target_image_id", "context_path", "target_path", "diagnosis",
    "anatomical_site", "pair_construction_reason", "augmentation_recipe_json", "review_decision", "review_notes",
)


def write_manifest(pairs: DataFrame, path: str) -> None:
    """Pairs by split, so that a stage reads its split alone; each split is written by several tasks."""
    pairs.repartition("split", F.pmod(F.xxhash64("pair_id"), F.lit(16))).write.partitionBy("split").parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def write_review(pairs: DataFrame, path: str) -> None:
    """The first five pairs of each split and label as one CSV, with two empty columns for the reviewer."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    few = first_per_label(pairs).withColumn("review_decision", F.lit("")).withColumn("review_notes", F.lit(""))
    few.orderBy(order, F.col("pair_label").desc(), "pair_id").select(*REVIEW).coalesce(1).write.csv(path, header=True, emptyValue="")


def write_near_duplicates(pairs: DataFrame, covered: DataFrame, within: int, path: str) -> None:
    """The pairs as CSV, nearest first, then as they stand in their archives, and how many images of each were hashed."""
    pairs.orderBy("distance", "archive", "position", "a_id").select("a_id", "b_id", "distance").write.csv(path, header=True)
    lines = [f"{r.archive}: {r.hashed} of {r.members} images hashed" for r in covered.orderBy("archive").collect()]  # a row an archive
    put(f"{path}.coverage.txt", "\n".join([f"threshold={within}", *lines, f"TOTAL near-duplicate pairs: {pairs.count()}", ""]).encode())


def write_document(path: Path, document: dict[str, Any]) -> None:
    """JSON with sorted keys, two spaces a level."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def write_checkpoint(path: Path, state: dict[str, Any], ids: dict[str, str]) -> None:
    """A predictor's arrays and the ids that it belongs to."""
    import numpy as np

    path.parent.mkdir(parents=True, exist_ok=True)
    arrays = {k: v for k, v in state.items() if isinstance(v, np.ndarray)}
    np.savez_compressed(path, kind=np.array(state["kind"]), **arrays, **{k: np.array(v) for k, v in ids.items()})


def model_card(title: str, facts: dict[str, Any], boundary: str) -> str:
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()], "", "## Boundary", "", boundary, ""]
    return "\n".join(lines)


def bar_chart(rows: list[tuple[str, float]], width: int = 480) -> str:
    """An SVG of bars, each as long as its share of the greatest value."""
    top = max([v for _, v in rows if v > 0], default=1.0)
    bars = [
        f'<text x="0" y="{i * 18 + 12}" font-size="11">{html.escape(name)}</text>'
        f'<rect x="160" y="{i * 18 + 3}" height="12" width="{max(0.0, value) / top * width:.1f}" fill="#3b6ea5"/>'
        for i, (name, value) in enumerate(rows)
    ]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 170}" height="{len(rows) * 18 + 6}">{"".join(bars)}</svg>\n'


def write_demo(folder: Path, run_id: str, pairs: list[dict[str, Any]], charts: list[dict[str, Any]], worst: list[dict[str, Any]] | None = None) -> None:
    """A bundle of JSON, HTML and images for a few pairs, and each model's worst ones; all lists come from small collects."""
    shown = []
    for p in pairs:
        own = dict(p)
        for side in ("context", "target"):
            source = str(p[f"{side}_path"])
            own[f"{side}_image"] = f"images/{len(shown)}-{side}.{source.rpartition('.')[2]}"
            with suppress(OSError):  # an image that is gone leaves its place empty
                copy(source, str((folder / own[f"{side}_image"]).resolve()))
        shown.append(own)
    write_document(folder / "demo.json", {"run_id": run_id, "pairs": shown, "scores": charts, "failure_cases": worst or []})
    cells = "".join(
        f"<tr><td>{html.escape(str(p['pair_id']))}</td><td>{html.escape(str(p['pair_label']))}</td>"
        f"<td><img src='{html.escape(p['context_image'])}'></td><td><img src='{html.escape(p['target_image'])}'></td></tr>"
        for p in shown
    )
    page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(run_id)}</title><table>{cells}</table>"
    (folder / "index.html").write_text(page, encoding="utf-8")


def append_log(folder: Path, name: str, line: str) -> None:
    """A line of a plain text log, with the time."""
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "a", encoding="utf-8") as log:
        log.write(f"{datetime.now(UTC).isoformat()} {line}\n")


def snapshot(folder: Path, config: Any, spark: Any) -> None:
    """The run's configuration and what it ran on, beside its results."""
    write_document(folder / "config.json", asdict(config))
    found = {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism}
    found |= {name: version(name) for name in ("pyspark", "pyarrow", "numpy", "pandas")}
    write_document(folder / "environment.json", found)


@contextmanager
def run_lock(folder: Path) -> Iterator[None]:
    """Hold a run's folder: a second run of the same name is refused while this one lasts."""
    folder.mkdir(parents=True, exist_ok=True)
    lock = folder / "run.lock"
    try:
        lock.touch(exist_ok=False)
    except FileExistsError:
        raise RuntimeError(f"{folder} is held by another run; remove {lock} if that has ended") from None
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)
