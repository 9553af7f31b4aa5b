"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.llm.common import WORD, Scratch, few, own_columns, quoted

#: Classes that the keys of a source are dealt into. Only the one that holds the cut is sorted.
CLASSES = 4096
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: The n-th source, by code point, has weight WEIGHTS[n % len(WEIGHTS)].
WEIGHTS = (1, 2, 3)


def quality_weight(text: Column, size: Column) -> Column:
    """2 for prose of 4 to 40 words a full stop, 0.5 for under 20 words, 1 for the rest."""
    stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.when(size < 20, 0.5).when((stops * 4 <= size) & (stops * 40 >= size), 2.0).otherwise(1.0)


def keyed(docs: DataFrame, seed: int, weight: Column | None = None) -> DataFrame:
    """(row, source, doc_id, _size, _key): each row as a struct, its words, and the sampling key u^(1/weight).

    u is uniform in (0, 1), from a hash of seed and id. The logarithm of the key is an
    exponential variable scaled by 1/weight; the greatest keys are taken first. ``weight`` is
    an expression of the columns of docs, such as a score of quality. A weight that is null, no
    number, zero or negative makes the key 0: such rows come after all others of their source, by id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    own = F.struct(*map(quoted, docs.columns)).alias("row")
    drawn = docs.select(own, "source", F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), size.alias("_size"), digest.alias("_digest"), *([] if weight is None else [weight.alias("_weight")]))
    u = (F.conv(F.substring("_digest", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    by = quality_weight(F.col("_text"), F.col("_size")) if weight is None else F.col("_weight")
    by = by.cast("double")
    key = F.when((by > 0) & ~F.isnan(by), F.pow(u, 1.0 / by)).otherwise(0.0)
    return drawn.select("row", "source", "doc_id", "_size", key.alias("_key"))


def plan(keys: DataFrame) -> DataFrame:
    """For each source: source_size, target, epochs and the cut within the last, part epoch.

    ``keys`` has source, doc_id, _size and _key. A target is weight times a level, at most
    MOST_EPOCHS times the source's size; the level is the one at which targets add up to all
    sizes. The cut (cut_key, cut_id, cut_size) is the last document that the part epoch takes;
    it is null if there is none. A document is taken while more than half of it fits.

    Rows shuffled are one for each source and class of keys; the cut's class alone is sorted.
    """
    dealt = keys.withColumn("_class", F.least(F.floor(F.col("_key") * CLASSES), F.lit(CLASSES - 1)).cast("int"))
    classes = dealt.groupBy("source", "_class").agg(F.sum("_size").alias("n"))
    sources = classes.groupBy("source").agg(F.sum("n").alias("source_size"))

    # One row for each source from here on; the windows order sources, not documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * MOST_EPOCHS)
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rising, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # Filling up to a level: with the sources before this one at their most, what is left for the others?
    ranked = ranked.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(rising), F.lit(0)))
    ranked = ranked.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.when(F.col("left") * F.col("weight") <= F.col("most") * F.col("weights"), F.col("left") / F.col("weights")))
    ranked = ranked.withColumn("level", F.max("level").over(every))  # those after the first only fall
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    targets = ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))

    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    down = Window.partitionBy("source").orderBy(F.col("_class").desc())
    before = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = classes.withColumn("before", before).alias("c").join(F.broadcast(targets).alias("t") if few(targets) else targets.alias("t"), same)
    cut_in = opened.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("n") >= F.col("part"))).select(F.col("c.source").alias("source"), "_class", "before", "part")
    cut_in = cut_in.groupBy("source").agg(F.max_by(F.struct("_class", "before", "part"), F.col("_class")).alias("x")).select("source", "x.*")

    inside = dealt.alias("d").join((F.broadcast(cut_in) if few(cut_in) else cut_in).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d._class") == F.col("c._class")))
    inside = inside.select("d.source", "doc_id", "_size", "_key", "before", "part")
    order = Window.partitionBy("source").orderBy(F.col("_key").desc(), F.col("doc_id").asc_nulls_last(), "_size")
    upto = F.col("before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = inside.withColumn("upto", upto).filter(F.col("upto") * 2 - F.col("_size") <= F.col("part") * 2)
    # With nothing taken in its class, the cut lies at the class's upper end.
    last = taken.groupBy("source").agg(F.min(F.struct(F.col("_key"), (-F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("id"), (-F.col("_size")).alias("size"))).alias("cut"))
    edge = cut_in.select("source", ((F.col("_class") + 1) / float(CLASSES)).alias("edge"))
    cuts = edge.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left")
    cuts = cuts.select(F.col("e.source").alias("source"), F.coalesce(F.col("cut"), F.struct(F.col("edge").alias("_key"), F.lit(0).cast("long").alias("id"), F.lit(1).cast("long").alias("size"))).alias("cut"))
    found = targets.alias("t").join(cuts.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")), "left")
    return found.select(F.col("t.source").alias("_source"), "source_size", "target", "epochs", "part", "cut")


def sources_of(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The keys of all rows and the plan of each source, both written."""
    keys = scratch.write(rows.select("source", "doc_id", "_size", "_key"), "keys")
    return keys, scratch.write(plan(keys), "sources")


def taken(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (source, doc_id, _size, _key and others) with source_size, target and _copies: how often each is taken."""
    joined = rows.join(F.broadcast(sources) if few(sources) else sources, F.col("source").eqNullSafe(F.col("_source")))
    own = F.struct(F.col("_key"), (-F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("id"), (-F.col("_size")).alias("size"))
    extra = F.when(F.col("cut").isNotNull() & (own >= F.col("cut")), 1).otherwise(0)
    copies = F.least(F.col("epochs") + extra, F.lit(MOST_EPOCHS)).cast("long")
    return joined.select(*rows.columns, "source_size", "target", copies.alias("_copies"))


def mix(docs: DataFrame, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    Whole epochs come first; the part epoch takes documents in the order of their keys until
    the target is reached within half a document. Reruns agree: keys are hashes of seed and id.
    Rows that repeat an id and a size share a key and are taken together. A null text has no
    words; null sources form one source, weighed last; null ids share a hash. Rows whose weight is
    null, no number, zero or negative come last in the part epoch of their source. Columns named
    like these four results give way to them; all others stay, whatever they are called. An
    empty table gives no rows. Sources are named collections: plans are made of one row each.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = keyed(docs, seed, weight)
    _, sources = sources_of(rows, scratch)
    scratch.keep("sources")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")])
    made = F.struct(F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"))
    return taken(rows, sources).select("row", made.alias("made")).select(*own_columns(kept), "made.*")


def mixed(docs: DataFrame, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """The mix itself: each row of docs, with all its own columns, as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = keyed(docs, seed, weight)
    _, sources = sources_of(rows, scratch)
    scratch.keep("sources")
    again = taken(rows, sources).filter("_copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return again.select(*own_columns(docs))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the keys alone: texts are read once, to count their words."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "mix")
    keys, sources = sources_of(keyed(docs, 7), scratch)
    out = taken(keys, sources)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 6).alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS chars,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), '.', '')) AS stops,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         pow(u, 1.0::DOUBLE / CASE WHEN size < 20 THEN 0.5::DOUBLE WHEN stops * 4 <= size AND stops * 40 >= size THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM keyed GROUP BY source),
-- each step caps the sources that the present level puts above three times their size
steps AS (
  SELECT 0 AS step, source, source_size, weight, false AS capped FROM sources
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         capped OR weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE
                   / sum(weight) FILTER (NOT capped) OVER () > 3 * source_size
  FROM steps WHERE step < 25),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 3.0::DOUBLE * source_size
              ELSE weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE
                   / sum(weight) FILTER (NOT capped) OVER () END AS target
  FROM steps WHERE step = 25),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS part,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k DESC, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       (size * least(epochs + CASE WHEN part > 0 AND upto * 2 - size <= part * 2 THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM ordered
"""
