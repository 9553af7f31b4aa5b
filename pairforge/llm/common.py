"""Helpers shared by the operators: scratch tables, stable row locators, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A lookup table of at most this many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

#: A key that holds at least 1/HOT_SHARE of all rows is hot. At most HOT_SHARE keys can be.
HOT_SHARE = 64

#: Rows that a Python worker gets at once: whole texts, so few of them.
BATCH_ROWS = 512

#: Bits of the map that tells rows to be read again from the rest: 8 MB, however many there are.
FILTER_BITS = 1 << 26

#: Where a row is stored.
PLACE = ("row_file", "row_at")

_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="pairforge-")
    return _LOCAL_ROOT[app]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within this block, a batch that goes to Python has at most BATCH_ROWS rows; then the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    now = int(before or "10000")
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within this block, Spark deletes the shuffle files of a written table when it is written; till then a lost task finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most BATCH_ROWS rows, so that few whole texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def give_back() -> None:
    """Return freed memory to the system, as a Python worker stays and serves other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Written tables that cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None) -> None:
        self.spark = spark
        self.path = folder.rstrip("/") if folder else f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        self.schemas: dict = {}
        self.noted: dict = {}

    def write(self, df: DataFrame, name: str, packing: str | None = None, **watched: Column) -> DataFrame:
        """The table, written and read again; ``watched`` aggregates are made while it is written, and kept in seen()."""
        path = f"{self.path}/{name}"
        with tidy(self.spark):
            if watched:
                noted = Observation()
                df.observe(noted, *[c.alias(k) for k, c in watched.items()]).write.parquet(path, compression=packing)
                self.noted[name] = noted.get
            else:
                df.write.parquet(path, compression=packing)
        self.names.append(name)
        self.schemas[name] = df.schema
        return self.table(name)

    def there(self, name: str) -> bool:
        """Whether a table of this name is written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """write(), or the table that a run before left in this folder."""
        if not self.there(name):
            self.drop(name)
            return self.write(df, name)
        self.names.append(name)
        self.schemas[name] = df.schema
        return self.table(name)

    def seen(self, name: str) -> dict:
        return self.noted[name]

    def sized(self, df: DataFrame, name: str, size: str) -> DataFrame:
        """write(), for a right side of lookup() by ``size``, whose sums need no job of their own."""
        out = self.write(df, name, rows=F.count(F.lit(1)), total=F.sum(size))
        out.known_sums = (self.seen(name)["rows"], self.seen(name)["total"])
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, or whatever else lies under these names."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
        self.names = [n for n in self.names if n not in names]

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which a result is still read from."""
        self.drop(*[n for n in self.names if n not in names])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def located(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, row_file, row_at): each row as a struct, whatever its columns are called, and where it is stored.

    The place is the same on every read. A DataFrame that is not a plain scan of files is written
    to scratch first; so is one whose rows may be repeated after the scan.
    """
    rows = df.select(F.struct(*map(quoted, df.columns)).alias("row"))
    place = [F.xxhash64(F.col("_metadata.file_path")).alias("row_file"), F.col("_metadata.row_index").alias("row_at")]
    if "_metadata" not in map(str.lower, df.columns) and _one_row_each(df):
        with suppress(AnalysisException):
            return df.select(F.struct(*map(quoted, df.columns)).alias("row"), *place)
    return scratch.write(rows, f"rows-{uuid.uuid4().hex[:8]}").select("row", *place)


def _one_row_each(df: DataFrame) -> bool:
    """Whether the plan only selects from and filters one scan, so that no stored row comes twice."""
    steps = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in df._jdf.queryExecution().analyzed().toString().splitlines()}
    return steps <= {"Project", "Filter", "Relation", "SubqueryAlias", ""}


def own_columns(df: DataFrame, row: str = "row") -> list[Column]:
    """The columns of df out of the struct that located() made of them."""
    return [F.col(row).getField(c).alias(c) for c in df.columns]


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def sized(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows; else left to be shuffled. For keys that no other side repeats often."""
    return F.broadcast(df) if few(df) else df


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """left joined with right, whose ``key`` is unique and whose ``size`` counts key's rows in left.

    A right side of checked size is broadcast. Otherwise the few hot keys, at most HOT_SHARE
    of them, are broadcast and the rest is shuffled, so no task gets a hot key's rows.
    """
    keys = [key] if isinstance(key, str) else key
    stats = getattr(right, "known_sums", None) or right.agg(F.count("*"), F.sum(size)).first()
    if stats[0] <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    hot = right.filter(F.col(size) * HOT_SHARE >= F.lit(stats[1]))
    cold = right.filter(F.col(size) * HOT_SHARE < F.lit(stats[1]))
    near = left.join(F.broadcast(hot), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only where wanted does not have the row's place.

    The marks are FILTER_BITS bits, hashed places, so what is broadcast does not grow with wanted.
    """
    bit = F.pmod(F.xxhash64(*PLACE), F.lit(FILTER_BITS)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_map"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(marks), "_bucket", "left")
    found = found.withColumn("_byte", byte).withColumn("_bit", (at % 8).cast("int"))
    return found.withColumn("maybe", F.coalesce(F.expr("shiftright(_byte, _bit) % 2 = 1"), F.lit(False))).drop("_bucket", "_map", "_byte", "_bit")


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows at the places of wanted, with its columns; of many places, only rows that are marked are shuffled."""
    if few(wanted):
        return rows.join(F.broadcast(wanted), list(PLACE))
    return _marked(rows, wanted).filter("maybe").drop("maybe").join(wanted, list(PLACE))


def beside(rows: DataFrame, some: DataFrame) -> DataFrame:
    """All rows, with the columns of some at its places and nulls elsewhere; rows that are not marked stay where they are."""
    if few(some):
        return rows.join(F.broadcast(some), list(PLACE), "left")
    both = _marked(rows, some)
    near = both.filter("maybe").drop("maybe").join(some, list(PLACE), "left")
    return near.unionByName(both.filter("not maybe").drop("maybe"), allowMissingColumns=True)
