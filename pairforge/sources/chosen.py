"""Files that a table of paths names, and no others."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.functions.whole import intact
from pairforge.sinks.files import open_store


def read_chosen(paths: DataFrame) -> DataFrame:
    """(path, content, whole) of the files that ``paths`` (path) names, each read once by the task that has its row.

    A listing that is joined with a scan of contents reads every file below its folders first;
    here only what is named is opened, in any store that Arrow opens. A file that is gone has
    null content; ``whole`` tells whether an image is there to its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():  # a batch a file, so that one is held at a time
                try:
                    store, name = open_store(path)
                    with store.open_input_stream(name) as file:
                        data = file.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([intact(data)])], ["path", "content", "whole"])

    tasks = 2 * paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").distinct().repartition(tasks).mapInArrow(run, "path string, content binary, whole boolean")
