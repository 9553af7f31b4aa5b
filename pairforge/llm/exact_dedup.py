"""Exact deduplication by stateful streaming, in DataFrame operations only."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import GAP, Scratch, fetch, located, lookup

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Small stores do not set aside disk ahead of use, else each takes megabytes whatever it holds.
SET_ASIDE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def normalised(text: str = "text"):
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), GAP, " ")


def arrivals(rows: DataFrame, digest_chars: int, deliveries: int) -> DataFrame:
    """One small row for each document: digest, stable id and content locator, and its delivery."""
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_file", "row_at").alias("self")
    full = F.sha2(F.encode(normalised(), "UTF-8"), 256)
    named = rows.select(full.alias("full"), own)
    return named.select(F.substring("full", 1, digest_chars).alias("digest"), "self", "full", F.pmod(F.xxhash64("self.row_file", "self.row_at"), F.lit(deliveries)).cast("int").alias("delivery"))


def first_seen(rows: DataFrame, seen: DataFrame, deliveries: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Stream the arrivals through keyed state: (digest, first, group_size), and digests that texts clash in.

    The state is digest -> first (least id and content locator), anchor (the locator that came
    first) and group_size. The store keeps its keys on disk and never expires one, so a copy is
    found however late it comes. Each delivery is a batch. A digest that is hit has the anchor
    that its state holds read, and the rows of the batch that have it, and their full bytes are compared
    before the batch is done: in an aggregation keyed by digest and text, which combines the rows
    of a hot group where they are read. Each batch writes the groups it changed to a log, which is
    read once, in the end: the largest batch of a digest is its present state.

    Deliveries, state, log and checkpoint lie in the scratch folder under fixed names, so a run
    over the same folder takes up where one before stopped: a delivery that is there is not
    written again, and the stream's checkpoint knows which batches are done.
    """
    spark, log, clash = rows.sparkSession, f"{scratch.path}/log", f"{scratch.path}/clash"
    come = F.struct("delivery", "self")
    grouped = lambda df: df.groupBy("digest").agg(F.min("self").alias("first"), F.min(come).alias("anchor"), F.max("delivery").alias("last"), F.count("*").alias("group_size"))
    small = seen.select("digest", "self", "delivery").schema
    plain = grouped(seen).schema
    logged = T.StructType([*plain, T.StructField("batch", T.IntegerType())])

    def check(changed: DataFrame, batch: int) -> None:
        # By what the state says and not by the driver's loop, as a batch that was stopped comes again.
        changed.write.mode("overwrite").parquet(f"{log}/batch={batch}")
        hits = spark.read.schema(plain).parquet(f"{log}/batch={batch}").filter("group_size > 1")
        now = hits.agg(F.max("last")).first()[0]
        arrived = lookup(seen.filter(F.col("delivery") == F.lit(now)).select("digest", "self"), hits.select("digest", "group_size"), "digest", "group_size").select("digest", "self")
        held = hits.filter("anchor.delivery < last").select("digest", F.col("anchor.self").alias("self"))
        places = scratch.write(arrived.unionByName(held).select("digest", "self.row_file", "self.row_at"), f"places-{batch}-{uuid.uuid4().hex[:6]}")
        texts = fetch(rows, places).select("digest", normalised().alias("norm"))
        texts = texts.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
        texts.filter("texts > 1").write.mode("overwrite").parquet(f"{clash}/batch={batch}")
        scratch.drop(*[n for n in scratch.names if n.startswith("places-")])

    with _setting(spark, STATE_STORE, ON_DISK), _setting(spark, SET_ASIDE, "false"):
        for now in range(deliveries):
            if not scratch.there(f"arriving/part={now}"):
                seen.filter(F.col("delivery") == now).select("digest", "self", "delivery").write.mode("overwrite").parquet(f"{scratch.path}/arriving/part={now}")
            state = grouped(spark.readStream.schema(small).parquet(f"{scratch.path}/arriving").select("digest", "self", "delivery"))
            query = state.writeStream.outputMode("update").foreachBatch(check).option("checkpointLocation", f"{scratch.path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    latest = spark.read.schema(logged).parquet(log).groupBy("digest").agg(F.max_by("first", "batch").alias("first"), F.max("group_size").alias("group_size"))
    found = scratch.sized(latest, "groups", "group_size")
    return found, spark.read.schema("digest string, texts long, batch int").parquet(clash).select("digest").distinct()


#: Batches that the rows of a table arrive in.
DELIVERIES = 3


def exact_dedup(docs: DataFrame, digest_chars: int = 64, deliveries: int = DELIVERIES, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    Texts are equal if they are identical after each run of white space is made one space; a
    null text counts as empty. Of equal texts the row with the least doc_id stays (null ids
    last; of rows that repeat an id, the one stored first). Where digests are equal, the full
    bytes are compared; texts that differ under one digest are grouped by their bytes instead.
    ``digest_chars`` shortens the state's key, for tests of that path; ``deliveries`` lets the
    rows arrive in so many batches. Other columns are ignored; an empty table gives no rows.

    ``folder``, in a store that all executors share, keeps deliveries, state and log. A run that
    was stopped is gone on with by a run of the same rows and numbers over the same folder, which
    may hold nothing else; docs must be a plain scan of files, as its rows are known by their places.
    """
    scratch = Scratch(docs.sparkSession, "dedup", folder)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = located(docs.select("doc_id", "text"), scratch).select("row.doc_id", "row.text", "row_file", "row_at")
    if folder is not None and scratch.names:
        raise ValueError("a folder to go on in needs a plain scan of files")
    seen = scratch.written(arrivals(rows, digest_chars, deliveries), "arrivals")
    scratch.drop("groups", "apart", "by-bytes")  # of a run that was stopped after its last batch
    state, clashing = first_seen(rows, seen, deliveries, scratch)
    if clashing.limit(1).count():
        places = scratch.write(seen.join(clashing, "digest", "left_semi").select("digest", "full", "self", "self.row_file", "self.row_at"), "apart")
        texts = fetch(rows, places).select("digest", "full", "self", F.sha2(F.encode(normalised(), "UTF-8"), 512).alias("bytes"))
        groups = texts.groupBy("digest", "bytes").agg(F.min("self").alias("first"), F.count("*").alias("group_size"))
        groups = scratch.sized(groups, "by-bytes", "group_size")
        apart = lookup(texts, groups, ["digest", "bytes"], "group_size").select("self", "first", "group_size", "full")
        state = state.join(clashing, "digest", "left_anti")
        found = lookup(seen, state, "digest", "group_size").select("self", "first", "group_size", "full").unionByName(apart)
    else:
        found = lookup(seen, state, "digest", "group_size")
    scratch.keep("arrivals", "groups", "apart", "by-bytes", *[n for n in scratch.names if n.startswith("rows-")])
    if folder is None:
        scratch.drop("arriving", "state", "log")
    return found.select(
        F.col("self.doc_id").cast(kind).alias("doc_id"),
        F.col("first.doc_id").cast(kind).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("self").eqNullSafe(F.col("first")).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH digests AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM digests
"""
