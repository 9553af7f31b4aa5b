"""Near duplicates of a stream of hashes, against an index that is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairforge.operators.neardup import near_in_index


def watch(spark: SparkSession, hashes: DataFrame, index: str, path: str, checkpoint: str, most: int = 10) -> StreamingQuery:
    """Write what is near to an index's classes, of all hashes (id, hash) that are there now and of later ones by further calls.

    ``hashes`` is a stream, such as a folder of hash tables that grows by an archive at a time.
    The checkpoint tells which of them are done, so a call that was stopped is gone on with.
    """
    found = near_in_index(hashes, spark.table(index), most)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
