"""Run logs: JSON lines of events, timed stages, throttled progress."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from datetime import UTC, datetime
from pathlib import Path
from typing import Any, TypeVar

T = TypeVar("T")
ERROR_CHARS = 400


def _plain(value: Any) -> Any:
    """value as something that JSON has; paths and other objects by their text."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [_plain(v) for v in value]
    return str(value)


def log_event(name: str, run_dir: Path | None = None, **fields: Any) -> dict[str, Any]:
    """Write one event to stdout and to the run's log. A log that cannot be written does not stop a run."""
    event = {"ts": datetime.now(UTC).isoformat(), "event": name, **{k: _plain(v) for k, v in fields.items()}}
    line = json.dumps(event)
    print(line, file=sys.stdout, flush=True)
    if run_dir is not None:
        with suppress(OSError), open(run_dir / "events.jsonl", "a", encoding="utf-8") as f:
            f.write(line + "\n")
    return event


@contextmanager
def stage(name: str, run_dir: Path | None = None, spark: Any = None, **fields: Any) -> Iterator[None]:
    """Log a stage's start, end and duration, or the error that ended it; Spark's jobs carry its name."""
    began = time.monotonic()
    log_event(f"{name}.start", run_dir, **fields)
    if spark is not None:
        spark.sparkContext.setJobDescription(name)
    try:
        yield
    except BaseException as error:
        log_event(f"{name}.error", run_dir, duration_s=round(time.monotonic() - began, 3), error=type(error).__name__, message=str(error)[:ERROR_CHARS], **fields)
        raise
    finally:
        if spark is not None:
            spark.sparkContext.setJobDescription(None)
    log_event(f"{name}.end", run_dir, duration_s=round(time.monotonic() - began, 3), **fields)


def progress(items: Iterable[T], name: str, total: int | None = None, every: int = 100, seconds: float = 30.0, run_dir: Path | None = None) -> Iterator[T]:
    """The items, with an event each ``every`` items or ``seconds``, and one at the end."""
    last, done = time.monotonic(), 0
    for done, item in enumerate(items, 1):
        yield item
        if done % every == 0 or time.monotonic() - last >= seconds:
            log_event(f"{name}.progress", run_dir, done=done, total=total)
            last = time.monotonic()
    log_event(f"{name}.done", run_dir, done=done, total=total)
