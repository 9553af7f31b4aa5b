"""Queries of the operators over the driver's tables, each with the SQL of its result.

The tables hold no images. Orders stand in for image records (order: image, customer: lesion,
priority: diagnosis, status: site), embeddings for image vectors, labels and text lengths for
scored pairs, and a hash of a text for a perceptual hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import text as names
from pairforge.functions.order import rounded_means
from pairforge.functions.vectors import cosine_distance, normalised
from pairforge.operators import audit, checks, corpus_audit, metrics, neardup, pairs, predictor, ranking, runs, split
from pairforge.schema import EMBEDDINGS
from pairforge.sinks import writers
from pairforge.sinks.scratch import shared_folder, stored
from pairforge.sources import artifacts, images, metadata

SEED = 17
#: Pairs of each split and draws of a bootstrap, as in the configuration's defaults.
STABLE, CHANGING, DRAWS = 1000, 1000, 1000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scored labels: quality as the label, text length as the score ---------------------------

LABELLED = """scored AS (
  SELECT l.quality AS label_int, CAST(d.n_chars AS DOUBLE) AS score, l.doc_id
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

CURVE = """counts AS (
  SELECT score, sum(label_int) AS pos, sum(1 - label_int) AS neg FROM scored GROUP BY score),
upto AS (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM counts WINDOW w AS (ORDER BY score DESC)),
bends AS (
  SELECT *, lag(tp) OVER w - 2 * tp + lead(tp) OVER w AS bt, lag(fp) OVER w - 2 * fp + lead(fp) OVER w AS bf
  FROM upto WINDOW w AS (ORDER BY score DESC)),
points AS (
  SELECT score AS threshold, tp, fp FROM bends WHERE bt IS NULL OR bt <> 0 OR bf <> 0
  UNION ALL SELECT 'infinity'::DOUBLE, 0, 0),
curve AS (
  SELECT row_number() OVER (ORDER BY threshold DESC) - 1 AS idx, threshold, tp, fp,
         tp::DOUBLE / max(tp) OVER () AS tpr, fp::DOUBLE / max(fp) OVER () AS fpr FROM points)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    both = labels.select("doc_id", F.col("quality").alias("label_int")).join(docs.select("doc_id", "n_chars"), "doc_id")
    return both.select("label_int", F.col("n_chars").cast("double").alias("score"), "doc_id")


@query(f"""WITH {LABELLED}, ranked AS (
  SELECT label_int, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)
SELECT round((sum(r) FILTER (label_int = 1) - count(*) FILTER (label_int = 1) * (count(*) FILTER (label_int = 1) + 1) / 2.0::DOUBLE)
       / (count(*) FILTER (label_int = 1) * count(*) FILTER (label_int = 0)), 9) AS auroc FROM ranked""")
def auroc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(scored(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"))


@query(f"""WITH {LABELLED}, counts AS (SELECT score, sum(label_int) AS pos, count(*) AS n FROM scored GROUP BY score),
upto AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM counts WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos::DOUBLE * tp / seen) / sum(pos), 9) AS auprc FROM upto""")
def auprc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auprc(scored(spark, sf_dir)).select(F.round("auprc", 9).alias("auprc"))


@query(f"WITH {LABELLED}, {CURVE} SELECT idx, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM curve")
def roc_points_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.roc_points(scored(spark, sf_dir))
    return points.select("idx", "threshold", "tp", "fp", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"""WITH {LABELLED}, {CURVE}
SELECT threshold AS eer_threshold, round((fpr + 1 - tpr) / 2, 9) AS equal_error_rate FROM curve ORDER BY abs(fpr - (1 - tpr)), idx LIMIT 1""")
def eer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.equal_error(metrics.roc_points(scored(spark, sf_dir)))
    return found.select("eer_threshold", F.round("equal_error_rate", 9).alias("equal_error_rate"))


@query(f"WITH {LABELLED}, {CURVE} SELECT round(coalesce(min(fpr) FILTER (tpr >= 0.8), 1.0), 9) AS fpr_at_fixed_tpr FROM curve")
def fpr_at_tpr_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.fpr_at_tpr(metrics.roc_points(scored(spark, sf_dir)), 0.8)
    return found.select(F.round("fpr_at_fixed_tpr", 9).alias("fpr_at_fixed_tpr"))


@query(f"""WITH {LABELLED}, numbered AS (SELECT label_int, score, row_number() OVER (ORDER BY md5('{SEED}/' || doc_id), doc_id) - 1 AS at_, count(*) OVER () AS n FROM scored),
draws AS (
  SELECT b.b, n.label_int, n.score FROM range({DRAWS}) b(b), (SELECT range AS i FROM range((SELECT count(*) FROM scored))) i
  JOIN numbered n ON n.at_ = CAST('0x' || substr(md5('{SEED}|' || b.b || '|' || i.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM scored)),
ranked AS (SELECT b, label_int, rank() OVER (PARTITION BY b ORDER BY score) + (count(*) OVER (PARTITION BY b, score) - 1) / 2.0::DOUBLE AS r FROM draws),
areas AS (
  SELECT (sum(r) FILTER (label_int = 1) - count(*) FILTER (label_int = 1) * (count(*) FILTER (label_int = 1) + 1) / 2.0::DOUBLE)
         / nullif(count(*) FILTER (label_int = 1) * count(*) FILTER (label_int = 0), 0) AS v FROM ranked GROUP BY b)
SELECT round(quantile_cont(v, 0.025), 9) AS auroc_ci_low, round(quantile_cont(v, 0.975), 9) AS auroc_ci_high FROM areas WHERE v IS NOT NULL""")
def bootstrap_auroc_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = metrics.bootstrap_native(scored(spark, sf_dir), "doc_id", DRAWS, 0.95, SEED)
    return ends.select(F.round("auroc_ci_low", 9).alias("auroc_ci_low"), F.round("auroc_ci_high", 9).alias("auroc_ci_high"))


def _mixed(name: str, source: str, value: str, keep: str) -> str:
    """CTEs that mix the bits of a 32-bit value, as metrics does; the result is ``m`` of the table ``name``."""
    a, b = metrics.MIX
    steps = [f"xor({value}, {value} >> 16)", f"(m * {a}::UBIGINT) % 4294967296", "xor(m, m >> 15)", f"(m * {b}::UBIGINT) % 4294967296", "xor(m, m >> 16)"]
    tables = [source, *[f"{name}_{i}" for i in range(4)], name]
    return ", ".join(f"{tables[i + 1]} AS (SELECT {keep}, {step} AS m FROM {tables[i]})" for i, step in enumerate(steps))


TAKEN = " + ".join(f"(m >= {t})::BIGINT" for t in metrics.poisson_limits())


@query(f"""WITH {LABELLED}, keyed AS (SELECT label_int, score, CAST('0x' || substr(md5('{SEED}/' || doc_id), 1, 8) AS UBIGINT) AS k FROM scored),
{_mixed("once", "keyed", "k", "label_int, score")},
crossed AS (SELECT label_int, score, b.b, xor(m, (b.b::UBIGINT * {metrics.APART}::UBIGINT) % 4294967296) AS x FROM once, range({DRAWS}) b(b)),
{_mixed("twice", "crossed", "x", "label_int, score, b")},
sums AS (SELECT b, score, sum(label_int * ({TAKEN})) AS pos, sum((1 - label_int) * ({TAKEN})) AS neg FROM twice GROUP BY b, score),
wins AS (SELECT b, pos, neg, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sums),
areas AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS v FROM wins GROUP BY b HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT round(quantile_cont(v, 0.025), 9) AS auroc_ci_low, round(quantile_cont(v, 0.975), 9) AS auroc_ci_high FROM areas""")
def bootstrap_auroc_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = metrics.bootstrap_merged(scored(spark, sf_dir), "doc_id", DRAWS, 0.95, SEED)
    return ends.select(F.round("auroc_ci_low", 9).alias("auroc_ci_low"), F.round("auroc_ci_high", 9).alias("auroc_ci_high"))


@query(f"""WITH {LABELLED}, {CURVE}, scoredby AS (SELECT s.*, d.lang FROM scored s JOIN documents d USING (doc_id)),
ranked AS (
  SELECT lang, label_int, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM scoredby)
SELECT lang, round((sum(r) FILTER (label_int = 1) - count(*) FILTER (label_int = 1) * (count(*) FILTER (label_int = 1) + 1) / 2.0::DOUBLE)
       / nullif(count(*) FILTER (label_int = 1) * count(*) FILTER (label_int = 0), 0), 9) AS auroc FROM ranked GROUP BY lang""")
def auroc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return metrics.auroc(scored(spark, sf_dir).join(langs, "doc_id"), ["lang"]).select("lang", F.round("auroc", 9).alias("auroc"))


@query(f"""WITH {LABELLED}, ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scored)
SELECT least(floor((score - lo) / ((hi - lo) / 35)), 34)::BIGINT AS bin, count(*) AS n FROM scored, ends GROUP BY 1""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the least to the greatest score, so that every row is counted."""
    rows = scored(spark, sf_dir)
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    return metrics.score_histogram(rows, low or 0.0, high or 0.0, 35)


@query(f"""WITH {LABELLED}, named AS (SELECT CASE WHEN label_int = 1 THEN 'changing' ELSE 'stable' END AS pair_label, score FROM scored)
SELECT round(avg(score) FILTER (pair_label = 'stable'), 6) AS stable_mean, round(avg(score) FILTER (pair_label = 'changing'), 6) AS changing_mean,
       round(avg(score) FILTER (pair_label = 'changing') - avg(score) FILTER (pair_label = 'stable'), 6) AS gap FROM named""")
def score_gap_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("pair_label", F.when(F.col("label_int") == 1, "changing").otherwise("stable"))
    return runs.score_gap(rows).select(*[F.round(c, 6).alias(c) for c in ("stable_mean", "changing_mean", "gap")])


@query("""WITH rows AS (
  SELECT d.lang AS model, d.doc_id AS pair_id, CASE WHEN l.quality = 1 THEN 'changing' ELSE 'stable' END AS pair_label, d.n_chars AS score
  FROM labels l JOIN documents d USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, pair_label ORDER BY CASE WHEN pair_label = 'stable' THEN -score ELSE score END,
                               CASE WHEN pair_label = 'stable' THEN -pair_id ELSE pair_id END) AS place FROM rows)
SELECT model, pair_id, pair_label, score, place,
       CASE WHEN pair_label = 'stable' THEN 'stable_high_score' ELSE 'changing_low_score' END AS failure_mode,
       CASE WHEN pair_label = 'stable' THEN 'Did nuisance variation dominate the score despite no proxy change?'
            ELSE 'Is this changing proxy visually too subtle or mismatched for the task?' END AS review_question
FROM ranked WHERE place <= 3""")
def top3_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(labels, "doc_id").select(F.col("lang").alias("model"), F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "changing").otherwise("stable").alias("pair_label"), F.col("n_chars").alias("score"), F.col("doc_id").alias("ordinal"))
    return ranking.failures(rows, "model").drop("ordinal")


# --- vectors ----------------------------------------------------------------------------------

PAIRED = """unit AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
paired AS (
  SELECT a.vec_id, CASE WHEN a.vec_id % 10 < 6 THEN 'train' WHEN a.vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
         CASE WHEN a.label = b.label THEN 'stable' ELSE 'changing' END AS pair_label,
         round(1 - greatest(-1.0, least(1.0, list_inner_product(a.v, b.v))), 6) AS score
  FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1)"""


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", "label", normalised(F.col("embedding")).alias("v"))
    target = unit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("target_label"), F.col("v").alias("w"))
    part = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "val").otherwise("test")
    label = F.when(F.col("label") == F.col("target_label"), "stable").otherwise("changing")
    return unit.join(target, "vec_id").select("vec_id", part.alias("split"), label.alias("pair_label"), F.round(cosine_distance(F.col("v"), F.col("w")), 6).alias("score"))


@query(f"WITH {PAIRED} SELECT * FROM paired")
def embedding_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pairs(spark, sf_dir)


@query(f"""WITH {PAIRED}, ranked AS (
  SELECT split, pair_label = 'changing' AS y, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS r FROM paired)
SELECT split, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc
FROM ranked GROUP BY split""")
def embedding_pair_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_pairs(spark, sf_dir).withColumn("label_int", names.label_int(F.col("pair_label")))
    return metrics.auroc(rows, ["split"]).select("split", F.round("auroc", 6).alias("auroc"))


@query("""WITH dims AS (SELECT generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
spread AS (SELECT dim, var_pop(x) AS v FROM dims GROUP BY dim),
norms AS (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT round(avg(n), 6) AS prediction_norm_mean, round(min(n), 6) AS prediction_norm_min,
       (SELECT round(avg(v), 9) FROM spread) AS dimension_variance_mean, (SELECT round(min(v), 9) FROM spread) AS dimension_variance_min,
       avg(n) <= 1e-8 OR (SELECT avg(v) FROM spread) <= 1e-8 AS collapsed FROM norms""")
def collapse_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.collapse_checks(table(spark, sf_dir, "embeddings"), "embedding")
    digits = {"prediction_norm_mean": 6, "prediction_norm_min": 6, "dimension_variance_mean": 9, "dimension_variance_min": 9}
    return found.select(*[F.round(c, d).alias(c) for c, d in digits.items()], "collapsed")


@query(f"""WITH {PAIRED}, areas AS (
  SELECT split, pair_label = 'changing' AS y, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS r FROM paired),
found AS (
  SELECT split, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc,
         CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS ordinal FROM areas GROUP BY split)
SELECT * FROM found ORDER BY auroc DESC, ordinal LIMIT 1""")
def strongest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_pair_auroc(spark, sf_dir)
    return metrics.strongest(found.withColumn("ordinal", F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)))


# --- records: orders as images, customers as lesions ------------------------------------------

RECORDS = """records AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS image_id, CAST(o_custkey AS VARCHAR) AS lesion_id, o_orderpriority AS diagnosis, o_orderstatus AS anatomical_site,
         o_custkey % 7 = 0 AS patient_id_available, CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey // 21 AS VARCHAR) ELSE 'missing_patient::' || o_custkey END AS patient_id
  FROM orders)"""

SPLIT = f"""{RECORDS}, grouped AS (
  SELECT *, CASE WHEN patient_id_available THEN 'patient::' || patient_id ELSE 'lesion::' || lesion_id END AS split_group FROM records),
ranked AS (
  SELECT split_group, row_number() OVER (ORDER BY md5('{SEED}/' || split_group), split_group) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT split_group FROM grouped)),
assigned AS (
  SELECT split_group, CASE WHEN r < round_even(n * 0.7, 0) THEN 'train' WHEN r < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM ranked),
placed AS (
  SELECT g.*, a.split, row_number() OVER (PARTITION BY a.split ORDER BY diagnosis, anatomical_site, lesion_id, image_id) - 1 AS p, count(*) OVER (PARTITION BY a.split) AS n
  FROM grouped g JOIN assigned a USING (split_group))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    patient = F.col("o_custkey") % 7 == 0
    key = F.col("o_custkey").cast("string")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("image_id"), key.alias("lesion_id"), F.lit(True).alias("lesion_id_available"),
        F.when(patient, F.expr("o_custkey div 21").cast("string")).otherwise(F.concat(F.lit("missing_patient::"), key)).alias("patient_id"),
        patient.alias("patient_id_available"), F.col("o_orderpriority").alias("diagnosis"), F.col("o_orderstatus").alias("anatomical_site"),
        F.lit("orders").alias("source_dataset"), F.concat(F.lit("/images/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"),
        F.lit(True).alias("image_found"), F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("long").cast("string")), 256).alias("checksum"),
        F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records by place; written, as anchors, their lesions and their targets are all taken from it."""
    return stored(pairs.positions(split.split_records(records(spark, sf_dir), SEED)), "placed")


@query(f"WITH {SPLIT} SELECT split, count(DISTINCT split_group) AS groups, count(*) AS images, count(DISTINCT lesion_id) AS lesions FROM placed GROUP BY split")
def grouped_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_records(records(spark, sf_dir), SEED)
    return rows.groupBy("split").agg(F.countDistinct("split_group").alias("groups"), F.count("*").alias("images"), F.countDistinct("lesion_id").alias("lesions"))


@query(f"WITH {SPLIT} SELECT split, p AS k, image_id, lesion_id FROM placed WHERE p < {STABLE}")
def stable_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.stable_anchors(placed(spark, sf_dir), STABLE).select("split", "k", "image_id", "lesion_id")


ANCHORS = f"""turns AS (
  SELECT a.*, ((a.p - {STABLE}) % a.n + a.n) % a.n + lap.lap * a.n AS k FROM placed a, range(4) lap(lap))"""


def _tries(stages: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS try, '{reason}' AS reason, * FROM tried WHERE {test}" for i, (reason, test) in enumerate(stages))


SAME_CELL = "a_dx = diagnosis AND a_site = anatomical_site"
ALL_STAGES = [
    ("different_lesion_same_patient", "a_has AND patient_id_available AND a_patient = patient_id"),
    ("different_lesion_same_diagnosis_and_site", SAME_CELL),
    ("different_lesion_same_diagnosis", "a_dx = diagnosis"),
    ("different_lesion_same_site", "a_site = anatomical_site"),
    ("different_lesion_unmatched_fallback", "true"),
]


def _picks(stages: list[tuple[str, str]], anchors: str) -> str:
    return f"""WITH {SPLIT}, {ANCHORS}, anchors AS ({anchors}),
tried AS (
  SELECT a.split, a.k, a.ordinal, a.image_id AS context, a.diagnosis AS a_dx, a.anatomical_site AS a_site, a.patient_id AS a_patient, a.patient_id_available AS a_has,
         c.image_id, c.lesion_id, c.diagnosis, c.anatomical_site, c.patient_id, c.patient_id_available
  FROM anchors a JOIN placed c ON a.split = c.split AND a.lesion_id <> c.lesion_id),
staged AS ({_tries(stages)}),
first AS (SELECT split, k, min(try) AS try FROM staged GROUP BY split, k),
lined AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.split, s.k ORDER BY s.diagnosis, s.anatomical_site, s.lesion_id, s.image_id) - 1 AS r,
         count(*) OVER (PARTITION BY s.split, s.k) AS m
  FROM staged s JOIN first f ON s.split = f.split AND s.k = f.k AND s.try = f.try)
SELECT split, k, ordinal, context AS context_image_id, image_id AS target_image_id, reason FROM lined WHERE r = k % m"""


STRICT = f"""SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.split ORDER BY t.k) - 1 AS ordinal FROM turns t
  WHERE EXISTS (SELECT 1 FROM placed c WHERE c.split = t.split AND c.diagnosis = t.diagnosis AND c.anatomical_site = t.anatomical_site AND c.lesion_id <> t.lesion_id))
WHERE ordinal < {CHANGING}"""
LOOSE = f"SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.split ORDER BY t.k) - 1 AS ordinal FROM turns t) WHERE ordinal < {CHANGING}"


def _picked(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    found = pairs.changing_pairs(placed(spark, sf_dir), STABLE, CHANGING, strict)
    return found.select("split", "k", "ordinal", F.col("image_id").alias("context_image_id"), F.col("target.image_id").alias("target_image_id"), "reason")


@query(_picks([ALL_STAGES[1]], STRICT))
def changing_pick_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir, True)


@query(_picks(ALL_STAGES, LOOSE))
def changing_pick_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir, False)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir)
    same = F.struct("patient_id", "lesion_id", "image_id", "path", "checksum", "width", "height").alias("target")
    stable = pairs.stable_anchors(rows, STABLE).select("*", same, F.col("k").alias("ordinal"))
    suffix = F.format_string("%s_stable_%04d", F.col("image_id"), F.col("ordinal").cast("int"))
    first = pairs.pair_rows(stable, "stable", F.lit("same_image_post_split_mild_nuisance"), F.lit("{}"), suffix, F.concat(F.lit("/variants/"), suffix, F.lit(".png")), "square_rgb")
    moved = pairs.changing_pairs(rows, STABLE, CHANGING)
    second = pairs.pair_rows(moved, "changing", F.col("reason"), F.lit('{"family":"none","severity":"none"}'), F.col("target.image_id"), F.col("target.path"), "square_rgb")
    return first.unionByName(second)


PICKED = f"""picked AS ({_picks(ALL_STAGES, LOOSE)}),
manifest AS (
  SELECT split || '_public_stable_' || lpad(CAST(p AS VARCHAR), 4, '0') AS pair_id, split, 'stable' AS pair_label, image_id AS context_image_id,
         image_id || '_stable_' || lpad(CAST(p AS VARCHAR), 4, '0') AS target_image_id, lesion_id AS context_lesion_id, lesion_id AS target_lesion_id,
         patient_id AS context_patient_id, patient_id AS target_patient_id, diagnosis, anatomical_site, 'same_image_post_split_mild_nuisance' AS pair_construction_reason
  FROM (WITH {SPLIT} SELECT * FROM placed) WHERE p < {STABLE}
  UNION ALL
  SELECT k.split || '_public_changing_' || lpad(CAST(k.ordinal AS VARCHAR), 4, '0'), k.split, 'changing', c.image_id, t.image_id, c.lesion_id, t.lesion_id,
         c.patient_id, t.patient_id, c.diagnosis, c.anatomical_site, k.reason
  FROM picked k JOIN (WITH {RECORDS} SELECT * FROM records) c ON c.image_id = k.context_image_id JOIN (WITH {RECORDS} SELECT * FROM records) t ON t.image_id = k.target_image_id)"""


@query(f"WITH {PICKED} SELECT * FROM manifest")
def pair_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["pair_id", "split", "pair_label", "context_image_id", "target_image_id", "context_lesion_id", "target_lesion_id", "context_patient_id", "target_patient_id", "diagnosis", "anatomical_site", "pair_construction_reason"]
    return manifest(spark, sf_dir).select(*cols)


@query(f"WITH {PICKED} SELECT split, count(*) FILTER (pair_label = 'stable') AS stable, count(*) FILTER (pair_label = 'changing') AS changing FROM manifest GROUP BY split")
def label_split_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_by_split(manifest(spark, sf_dir))


@query(f"WITH {PICKED} SELECT split, diagnosis, count(*) AS n FROM manifest GROUP BY ALL")
def freq_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.frequencies(manifest(spark, sf_dir), "split", "diagnosis")


@query(f"""WITH {PICKED} SELECT split, pair_label, pair_id, place FROM (
  SELECT *, row_number() OVER (PARTITION BY split, pair_label ORDER BY pair_id) AS place FROM manifest) WHERE place <= 5""")
def first5_per_split_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_per_label(manifest(spark, sf_dir)).select("split", "pair_label", "pair_id", "place")


def _rules(name: str) -> str:
    """The rules of a manifest in SQL: what breaks them in the table of this name."""
    overlaps = " UNION ALL ".join(
        f"""SELECT '{side} in one split' AS rule, a.split || ' ' || b.split || ' ' || a.v AS detail
  FROM (SELECT DISTINCT split, unnest([context_{side}_id, target_{side}_id]) AS v FROM {name}) a JOIN (SELECT DISTINCT split, unnest([context_{side}_id, target_{side}_id]) AS v FROM {name}) b ON a.v = b.v
  WHERE (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test'))"""
        for side in ("lesion", "patient")
    )
    return f"""SELECT 'unique pair_id' AS rule, pair_id AS detail FROM {name} GROUP BY pair_id HAVING count(*) > 1
UNION ALL SELECT 'known split', pair_id FROM {name} WHERE coalesce(split NOT IN ('train', 'val', 'test'), true)
UNION ALL SELECT 'known label', pair_id FROM {name} WHERE pair_label NOT IN ('stable', 'changing')
UNION ALL SELECT 'preprocessing profile', pair_id FROM {name} WHERE coalesce(preprocessing_profile, '') = ''
UNION ALL SELECT 'stable pairs keep the lesion', pair_id FROM {name} WHERE pair_label = 'stable' AND coalesce(context_lesion_id <> target_lesion_id, true)
UNION ALL SELECT 'changing pairs change the lesion', pair_id FROM {name} WHERE pair_label = 'changing' AND coalesce(context_lesion_id = target_lesion_id, true)
UNION ALL {overlaps}
UNION ALL SELECT 'both labels in each split', split FROM {name} GROUP BY split HAVING count(DISTINCT pair_label) FILTER (pair_label IN ('stable', 'changing')) < 2
UNION ALL SELECT 'manifest not empty', '' FROM (SELECT count(*) AS n FROM {name}) WHERE n = 0"""


@query(f"WITH {PICKED}, whole AS (SELECT *, 'square_rgb' AS preprocessing_profile FROM manifest) {_rules('whole')}")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs of orders, which are written once and then checked."""
    return checks.manifest_violations(stored(manifest(spark, sf_dir), "manifest"))


@query("""WITH values_ AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'val' ELSE 'test' END AS split, CAST(o_custkey AS VARCHAR) AS v FROM orders)
SELECT a.split AS left_split, b.split AS right_split, a.v AS value FROM values_ a JOIN values_ b ON a.v = b.v
WHERE (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test'))""")
def leakage_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders split by their own keys, so that customers leak, on purpose: over all orders."""
    part = F.when(F.col("o_orderkey") % 3 == 0, "train").when(F.col("o_orderkey") % 3 == 1, "val").otherwise("test")
    lesion = F.col("o_custkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(part.alias("split"), lesion.alias("context_lesion_id"), lesion.alias("target_lesion_id"))
    return checks.split_overlap(rows, "context_lesion_id", "target_lesion_id")


def also(name: str, whole: Query) -> None:
    """The same query under a second name."""
    QUERIES[name], SQL[name] = whole, SQL[whole.__name__]


also("leakage_overlap", leakage_overlap_all)


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_ids(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), "id")


@query("SELECT sha256(text) AS checksum, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def dup_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select((F.col("text") != "").alias("image_found"), F.sha2("text", 256).alias("checksum"))
    return audit.duplicate_checksums(found)


@query(f"""WITH {RECORDS} SELECT count(*) AS records, count(*) AS lesion_id_present, count(*) FILTER (patient_id_available) AS patient_id_present,
       count(*) FILTER (diagnosis <> 'unknown_diagnosis') AS diagnosis_present, count(*) FILTER (anatomical_site <> 'unknown_site') AS anatomical_site_present,
       count(*) AS found, 0::BIGINT AS missing FROM records""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(records(spark, sf_dir))


@query("SELECT source AS image_id, arg_max(doc_id, doc_id) AS path FROM documents GROUP BY source")
def unique_images_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("image_id"), F.col("doc_id").alias("path"), F.col("doc_id").alias("ordinal"))
    return audit.last_path(rows, "image_id", "path", "ordinal")


@query("""SELECT doc_id FROM documents WHERE sha256(text) IN (
  SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sha256(text) FROM benchmark)""")
def contamination_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another document or an item of the benchmark has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    copied = docs.groupBy("checksum").agg(F.count("*").alias("n")).filter("n > 1").select("checksum")
    items = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("checksum"))
    return neardup.members(docs, copied.unionByName(items), "checksum").select("doc_id")


also("contamination_semi_join", contamination_all)

HASHED = """hashed AS (SELECT vec_id AS id, CAST('0x' || substr(md5(CAST(vec_id // 2 AS VARCHAR)), 1, 15) AS BIGINT) + vec_id % 2 * 37 AS h FROM embeddings)"""


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    digest = F.md5(F.expr("vec_id div 2").cast("string"))
    return rows.select(F.col("vec_id").alias("id"), (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") + F.col("vec_id") % 2 * 37).alias("hash"))


@query(f"""WITH {HASHED} SELECT a.id AS a_id, b.id AS b_id, bit_count(xor(a.h, b.h))::INTEGER AS distance
FROM hashed a JOIN hashed b ON a.id % 2 = 0 AND b.id % 2 = 1 AND bit_count(xor(a.h, b.h)) <= 10""")
def hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    return neardup.hamming_join(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"))


@query(f"""WITH {HASHED}, near AS (
  SELECT bit_count(xor(a.h, b.h)) AS d FROM hashed a JOIN hashed b ON a.id % 2 = 0 AND b.id % 2 = 1 AND bit_count(xor(a.h, b.h)) <= 10)
SELECT b.b::INTEGER AS distance, count(d) FILTER (d <= b.b) AS n FROM (VALUES (0), (2), (4), (6), (8), (10)) b(b) LEFT JOIN near ON true GROUP BY b.b""")
def hamming_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.distance_bands(hamming_join(spark, sf_dir))


@query("""WITH v AS (SELECT p_partkey, p_size % 13 AS d1, p_size % 11 AS d2, p_size % 9 AS d3, p_size % 7 AS d4 FROM part)
SELECT *, (d1 <= 6)::INTEGER + (d2 <= 6)::INTEGER + (d3 <= 6)::INTEGER + (d4 <= 6)::INTEGER AS votes FROM v
WHERE (d1 <= 6)::INTEGER + (d2 <= 6)::INTEGER + (d3 <= 6)::INTEGER + (d4 <= 6)::INTEGER >= 3""")
def hash_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 13 as d1", "p_size % 11 as d2", "p_size % 9 as d3", "p_size % 7 as d4")
    return neardup.agreeing(rows, ["d1", "d2", "d3", "d4"])


COPIES = """hashed AS (SELECT doc_id AS id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h FROM documents WHERE text IS NOT NULL),
a AS (SELECT h, min(id) AS id, count(*) AS n FROM hashed WHERE id % 2 = 0 GROUP BY h), b AS (SELECT h, min(id) AS id, count(*) AS n FROM hashed WHERE id % 2 = 1 GROUP BY h)"""


@query(f"""WITH {COPIES} SELECT a.id AS a_id, b.id AS b_id, a.n AS n_a, b.n AS n_b, bit_count(xor(a.h, b.h))::INTEGER AS distance
FROM a JOIN b ON bit_count(xor(a.h, b.h)) <= 10""")
def copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids beside those of odd ones, by hashes of their texts: copies as classes, not as pairs."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("hash"))
    return neardup.hamming_classes(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")).select("a_id", "b_id", "n_a", "n_b", "distance")


FOUR = ("perceptual", "difference", "wavelet", "average")
FOUR_SQL = ", ".join(f"CAST('0x' || substr(md5('{name}/' || CAST(vec_id // 2 AS VARCHAR)), 1, 15) AS BIGINT) + vec_id % 2 * {flip} AS {name}" for name, flip in zip(FOUR, (3, 40, 1023, 7), strict=True))
VOTES = " + ".join(f"(bit_count(xor(a.{name}, b.{name})) <= 6)::INTEGER" for name in FOUR)


@query(f"""WITH hashed AS (SELECT vec_id AS id, {FOUR_SQL} FROM embeddings)
SELECT a.id AS a_id, b.id AS b_id, {VOTES} AS votes, 1::BIGINT AS n_a, 1::BIGINT AS n_b FROM hashed a JOIN hashed b ON a.id % 2 = 0 AND b.id % 2 = 1 AND {VOTES} >= 3""")
def agreeing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images with four hashes each, of which three must agree."""
    own = lambda name, flip: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}/"), F.expr("vec_id div 2").cast("string"))), 1, 15), 16, 10).cast("long") + F.col("vec_id") % 2 * flip).alias(name)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[own(n, f) for n, f in zip(FOUR, (3, 40, 1023, 7), strict=True)])
    return neardup.agreeing_classes(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), list(FOUR))


# --- runs -------------------------------------------------------------------------------------

RUN_VALUES = "runs AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS v FROM events GROUP BY ALL)"


@query(f"""WITH {RUN_VALUES} SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(avg(v) - 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(v)), 6) AS ci_low, round(avg(v) + 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(v)), 6) AS ci_high
FROM runs GROUP BY event_type""")
def seed_sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    found = runs.sweep(seeds, "event_type", "v")
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "ci_low", "ci_high")])


@query("""WITH observed AS (SELECT CAST(l_suppkey AS VARCHAR) AS run_id, round(avg(l_discount), 3) AS observed FROM lineitem GROUP BY 1),
expected AS (SELECT CAST(s_suppkey AS VARCHAR) AS run_id, 0.05 AS expected FROM supplier)
SELECT run_id, expected, observed, CASE WHEN observed IS NULL THEN 'SKIP' WHEN abs(observed - expected) <= 0.0015 THEN 'PASS' ELSE 'FAIL' END AS status
FROM expected LEFT JOIN observed USING (run_id)""")
def tolerance_check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all line items; a mean on a tie is that of discounts added up as they are stored."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("run_id"), F.col("l_discount").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    observed = rounded_means(items, ["run_id"], "value", 3, ["file", "row"])
    expected = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.lit(0.05).alias("value"))
    return runs.check_claims(expected, observed, tolerance=0.0015)


also("tolerance_check", tolerance_check_all)


@query("""SELECT n_nationkey, list_extract(['strong', 'strong_held_out', 'mild'], n_nationkey % 3 + 1) AS family, n_nationkey % 3 = 1 AS blurred, n_nationkey % 3 = 2 AS noisy FROM nation""")
def recipe_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey")
    listed = names.families(F.lit(" strong, strong_held_out,,mild "))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.family_at(listed, i).alias("family"), (F.pmod(i, F.lit(3)) == 1).alias("blurred"), (F.pmod(i, F.lit(3)) == 2).alias("noisy"))


@query("""WITH s AS (SELECT r_regionkey, list_extract(['strong', 'strong_held_out', 'strong_held_out_2', 'mild', 'strong,mild'], r_regionkey + 1) AS s FROM region)
SELECT r_regionkey, 'same_image_post_split_' || CASE WHEN s LIKE '%,%' THEN 'mixed' ELSE s END || '_nuisance' AS reason FROM s""")
def reason_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(*map(F.lit, ("strong", "strong_held_out", "strong_held_out_2", "mild", "strong,mild")))
    listed = names.families(F.get(options, F.col("r_regionkey")))
    return table(spark, sf_dir, "region").select("r_regionkey", names.stable_reason(listed).alias("reason"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'collapsed_representation' WHEN c_acctbal / 10000 >= 0.05 THEN 'clear_improvement'
       WHEN c_acctbal / 10000 >= 0 THEN 'marginal_or_equal' ELSE 'below_baseline' END AS outcome FROM customer""")
def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", names.outcome(F.col("c_acctbal") / 10000, F.col("c_custkey") % 9 == 0).alias("outcome"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


@query("""SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_brand END), ''), nullif(trim(p_type), ''), 'unknown_diagnosis') AS diagnosis,
       regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe, regexp_replace(regexp_replace(printf('%.6f', p_retailprice), '0+$', ''), '\\.$', '') AS number FROM part""")
def normalised_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_brand"))
    filled = F.coalesce(names.first_filled([brand, F.col("p_type")]), F.lit("unknown_diagnosis"))
    return table(spark, sf_dir, "part").select("p_partkey", filled.alias("diagnosis"), names.safe_name(F.col("p_name")).alias("safe"), names.short_number(F.col("p_retailprice")).alias("number"))


@query("""WITH shown AS (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 24)
SELECT doc_id, n_chars, round(n_chars::DOUBLE / CASE WHEN max(n_chars) OVER () > 0 THEN max(n_chars) OVER () ELSE 1 END, 9) AS share FROM shown""")
def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.bars(rows, "n_chars", 24, "doc_id").withColumn("share", F.round("share", 9))


# --- checks on rows that break rules -----------------------------------------------------------

#: A manifest of orders that breaks every rule: repeated ids, a fourth split, a third label, lesions and patients in two splits.
BROKEN = """broken AS (
  SELECT CAST(o_orderkey // 2 AS VARCHAR) AS pair_id,
         CASE o_orderkey % 7 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'extra' WHEN 3 THEN NULL ELSE 'train' END AS split,
         CASE WHEN o_orderkey % 7 = 1 THEN 'stable' WHEN o_orderstatus = 'F' THEN 'stable' WHEN o_orderstatus = 'O' THEN 'changing' ELSE 'other' END AS pair_label,
         CASE WHEN o_custkey % 10 = 0 THEN '' WHEN o_custkey % 10 = 1 THEN NULL ELSE 'square_rgb' END AS preprocessing_profile,
         CAST(o_custkey AS VARCHAR) AS context_lesion_id, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(o_custkey + o_orderkey % 2 AS VARCHAR) END AS target_lesion_id,
         CAST(o_custkey // 5 AS VARCHAR) AS context_patient_id, CAST(o_custkey // 5 AS VARCHAR) AS target_patient_id
  FROM orders)"""


def broken_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, custom = F.col("o_orderkey"), F.col("o_custkey")
    turn, status = key % 7, F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 2").cast("string").alias("pair_id"),
        F.when(turn == 0, "val").when(turn == 1, "test").when(turn == 2, "extra").when(turn == 3, None).otherwise("train").alias("split"),
        F.when(turn == 1, "stable").when(status == "F", "stable").when(status == "O", "changing").otherwise("other").alias("pair_label"),
        F.when(custom % 10 == 0, "").when(custom % 10 == 1, None).otherwise("square_rgb").alias("preprocessing_profile"),
        custom.cast("string").alias("context_lesion_id"), F.when(custom % 9 == 0, None).otherwise((custom + key % 2).cast("string")).alias("target_lesion_id"),
        F.expr("o_custkey div 5").cast("string").alias("context_patient_id"), F.expr("o_custkey div 5").cast("string").alias("target_patient_id"),
    )


@query(f"WITH {BROKEN} {_rules('broken')}")
def manifest_rules_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.manifest_violations(broken_pairs(spark, sf_dir))


@query("""WITH r AS (SELECT p_brand AS image_id, p_size % 5 <> 0 AS image_found FROM part)
SELECT 'unique image_id' AS rule, image_id AS detail FROM r GROUP BY image_id HAVING count(*) > 1
UNION ALL SELECT 'image present', image_id FROM r WHERE NOT image_found
UNION ALL SELECT 'at least six images', CAST(n AS VARCHAR) FROM (SELECT count(*) FILTER (image_found) AS n FROM r) WHERE n < 6""")
def record_rules_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.record_violations(table(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), (F.col("p_size") % 5 != 0).alias("image_found")))


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey END AS lesion_id FROM supplier),
sizes AS (SELECT s.split, count(DISTINCT lesion_id) AS lesions, count(lesion_id) AS images FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN r ON r.split = s.split GROUP BY s.split)
SELECT 'two lesions in each split' AS rule, split AS detail FROM sizes WHERE lesions < 2
UNION ALL SELECT 'an image for each pair', split FROM sizes WHERE images < 5""")
def split_rules_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = F.col("s_suppkey") % 4 == 0
    rows = table(spark, sf_dir, "supplier").select(F.when(val, "val").otherwise("train").alias("split"), F.when(val, 0).otherwise(F.col("s_suppkey")).alias("lesion_id"))
    return checks.split_violations(rows, 5, 3)


@query("""SELECT DISTINCT image_id FROM (SELECT unnest([vec_id, vec_id + 3]) AS image_id FROM embeddings) WHERE image_id NOT IN (SELECT vec_id FROM embeddings)""")
def pairs_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return checks.missing_vectors(vectors.select(F.col("image_id").alias("context_image_id"), (F.col("image_id") + 3).alias("target_image_id")), vectors)


@query("""WITH rows AS (SELECT d.lang, l.quality, CASE WHEN d.lang = 'de' AND l.doc_id % 9 = 0 THEN NULL ELSE d.n_chars END AS score FROM labels l JOIN documents d USING (doc_id)),
counts AS (SELECT lang, count(*) AS n, count(*) FILTER (score IS NULL OR y IS NULL OR y NOT IN (0, 1)) AS n_invalid, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg
           FROM (SELECT *, CASE WHEN lang = 'fr' THEN 1 WHEN lang = 'es' THEN quality + 1 ELSE quality END AS y FROM rows) GROUP BY lang)
SELECT * FROM counts WHERE n_invalid > 0 OR n_pos = 0 OR n_neg = 0""")
def groups_without_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    label = F.when(F.col("lang") == "fr", 1).when(F.col("lang") == "es", F.col("quality") + 1).otherwise(F.col("quality"))
    score = F.when((F.col("lang") == "de") & (F.col("doc_id") % 9 == 0), None).otherwise(F.col("n_chars"))
    return metrics.invalid_groups(labels.join(docs, "doc_id").select("lang", label.alias("label_int"), score.alias("score")), ["lang"])


# --- summaries, predictors, names ---------------------------------------------------------------


@query(f"""WITH {LABELLED}, {CURVE}, ranked AS (
  SELECT label_int, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored),
area AS (SELECT (sum(r) FILTER (label_int = 1) - count(*) FILTER (label_int = 1) * (count(*) FILTER (label_int = 1) + 1) / 2.0::DOUBLE)
                / (count(*) FILTER (label_int = 1) * count(*) FILTER (label_int = 0)) AS auroc FROM ranked),
gain AS (SELECT sum((tp - before)::DOUBLE * tp / (tp + fp)) / max(tp) AS auprc FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS before FROM upto)),
eer AS (SELECT threshold, (fpr + 1 - tpr) / 2 AS rate FROM curve ORDER BY abs(fpr - (1 - tpr)), idx LIMIT 1)
SELECT round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, eer.threshold AS eer_threshold, round(eer.rate, 9) AS equal_error_rate,
       (SELECT round(coalesce(min(fpr) FILTER (tpr >= 0.8), 1.0), 9) FROM curve) AS fpr_at_fixed_tpr, 0.8::DOUBLE AS fixed_tpr FROM area, gain, eer""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metric_summary(scored(spark, sf_dir), (), 0.8)
    return found.select(*[F.round(c, 9).alias(c) for c in ("auroc", "auprc")], "eer_threshold", *[F.round(c, 9).alias(c) for c in ("equal_error_rate", "fpr_at_fixed_tpr")], "fixed_tpr")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'mild' ELSE 'strong,strong_held_out' END AS held_out, CASE WHEN n_nationkey % 3 = 0 THEN 'mild' ELSE 'strong' END AS same FROM nation""")
def split_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey") % 3
    part = F.when(i == 0, "train").when(i == 1, "val").otherwise("test")
    plain = F.when(i == 0, names.severity(F.lit("train"), "mild", "strong")).otherwise(names.severity(part, "strong", None))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.severity(part, "mild", "strong,strong_held_out").alias("held_out"), plain.alias("same"))


@query("SELECT n_nationkey + 1 AS epoch FROM nation WHERE n_nationkey + 1 IN (1, 25) OR (n_nationkey + 1) % 2 = 0")
def recorded_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.col("n_nationkey") + 1
    return table(spark, sf_dir, "nation").filter(predictor.recorded_at(epoch, 25)).select(epoch.alias("epoch"))


@query("""SELECT round(avg((x - y) * (x - y)), 9) AS loss, count(*) AS numbers FROM (
  SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def identity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return predictor.mean_squared_error(rows.join(after, "vec_id")).select(F.round("loss", 9).alias("loss"), "numbers")


@query(f"WITH {PAIRED} SELECT vec_id, round(score, 4) AS score FROM paired")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear predictor of twice the context, whose direction is the context's: its score is the pair's cosine distance."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    twice = {"kind": "linear", "weight": 2.0 * np.eye(64), "bias": np.zeros(64)}
    return predictor.score(rows.join(after, "vec_id"), twice).select("vec_id", F.round(F.round("score", 6), 4).alias("score"))


#: A predictor that moves vectors: weights and biases by rule, in double precision.
FIXED = {"kind": "linear", "weight": np.fromfunction(lambda i, j: ((i * 7 + j * 3) % 11 - 5) / 10 + (i == j), (64, 64)), "bias": (np.arange(64) % 5 - 2) / 10.0}
NEIGHBOURS = """pairs AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return rows.join(after, "vec_id").withColumn("pair_id", F.col("vec_id").cast("string"))


@query(f"""WITH {NEIGHBOURS},
moved AS (
  SELECT vec_id, y, list_transform(range(64), lambda j: (j % 5 - 2) / 10.0::DOUBLE + list_inner_product(x, list_transform(range(64), lambda i: ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE + CASE WHEN i = j THEN 1 ELSE 0 END))) AS p FROM pairs)
SELECT vec_id, round(1 - list_inner_product(p, y) / sqrt(list_inner_product(p, p)) / sqrt(list_inner_product(y, y)), 6) AS score FROM moved""")
def predicted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear predictor with a weight matrix and a bias that move each vector, scored against the next vector."""
    return predictor.score(neighbours(spark, sf_dir), FIXED).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {NEIGHBOURS}, n AS (SELECT count(*) AS n FROM pairs),
cells AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS x, unnest(y) AS y FROM pairs),
summed AS (SELECT a.i, b.i AS j, sum(a.x * (b.x - b.y)) AS s FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(CASE WHEN i = j THEN 1 ELSE 0 END - 20.0::DOUBLE * 2 * s / (n * 64), 6) + 0.0 AS weight FROM summed, n
UNION ALL SELECT -1, i::INTEGER, round(-20.0::DOUBLE * 2 * sum(x - y) / max(n), 6) + 0.0 FROM cells, n GROUP BY i""")
def fitted_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the fit that adds up gradients where pairs are, over all pairs, from identity: its weights, and its bias as row -1."""
    rows, dim = neighbours(spark, sf_dir), 64
    start = {"weight": np.eye(dim), "bias": np.zeros(dim)}
    state = predictor.fit_stored(rows, rows.limit(1), "linear", seed=SEED, epochs=1, batch=max(1, rows.count()), rate=20.0, decay=0.0, start=start)
    cells = [(i, j, float(w)) for i, line in enumerate(state["weight"]) for j, w in enumerate(line)] + [(-1, j, float(b)) for j, b in enumerate(state["bias"])]
    return spark.createDataFrame(cells, "i int, j int, weight double").select("i", "j", (F.round("weight", 6) + 0.0).alias("weight"))


@query("""WITH v AS (SELECT p_partkey, 'the loss fell by ' || (p_size % 40) || '.5 % in all' AS t, CASE WHEN p_size % 8 = 0 THEN 0.0 ELSE p_retailprice END AS first, p_retailprice * (100 - p_size % 41) / 100 AS last FROM part),
w AS (SELECT *, CASE WHEN first = 0 THEN NULL ELSE (first - last) / first * 100 END AS fell, CAST(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) AS said FROM v)
SELECT p_partkey, round(fell, 6) AS fell, coalesce(abs(said - round(fell, 6)) <= 0.5, false) AS stated FROM w""")
def stated_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("the loss fell by "), (F.col("p_size") % 40).cast("string"), F.lit(".5 % in all"))
    first, last = F.when(F.col("p_size") % 8 == 0, 0.0).otherwise(F.col("p_retailprice")), F.col("p_retailprice") * (100 - F.col("p_size") % 41) / 100
    fell = F.round(runs.loss_reduction(first, last), 6)
    return table(spark, sf_dir, "part").select("p_partkey", fell.alias("fell"), runs.stated(text, fell).alias("stated"))


@query(f"""WITH {LABELLED}, byl AS (SELECT s.*, d.lang FROM scored s JOIN documents d USING (doc_id)),
ranked AS (SELECT lang, label_int, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM byl),
areas AS (SELECT round((sum(r) FILTER (label_int = 1) - count(*) FILTER (label_int = 1) * (count(*) FILTER (label_int = 1) + 1) / 2.0::DOUBLE)
                 / nullif(count(*) FILTER (label_int = 1) * count(*) FILTER (label_int = 0), 0), 9) AS a FROM ranked GROUP BY lang)
SELECT max(a) AS strongest, 'strongest AUROC >= 0.55' AS criterion, coalesce(max(a) >= 0.55, false) AS passed FROM areas""")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.accepted(auroc_by_language(spark, sf_dir), 0.55)


@query(f"""WITH {RECORDS}, c AS (SELECT count(*) AS n, count(*) FILTER (patient_id_available) AS patients FROM records)
SELECT '{audit.NOTE["always"]}' || CASE WHEN patients = 0 THEN ' {audit.NOTE["no_patients"]}' ELSE '' END || ' {audit.NOTE["no_lesions"]}' || ' {audit.NOTE["missing"]}' AS note FROM c""")
def leakage_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if one record had no lesion, and two no image."""
    counts = records(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("patient_id_available").alias("patients"))
    return counts.select(audit.leakage_note(F.col("n"), F.col("n") - 1, F.col("patients"), F.lit(0), F.lit(2)).alias("note"))


# --- sources and runs over stand-in rows ---------------------------------------------------------


@query("""WITH ids AS (SELECT 's' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '.png' ELSE '' END AS image_id FROM supplier),
files AS (SELECT c_custkey % 2 AS root, 's' || (c_custkey // 3) || list_extract(['.jpg', '.png', '.jpeg'], c_custkey % 3 + 1) AS file, c_custkey FROM customer),
tries AS (
  SELECT image_id, 0 AS ext, image_id AS file FROM ids WHERE image_id LIKE '%.png'
  UNION ALL SELECT image_id, e.i, image_id || '.' || e.name FROM ids, (VALUES (0, 'jpeg'), (1, 'jpg'), (2, 'png')) e(i, name) WHERE image_id NOT LIKE '%.png')
SELECT image_id, arg_min(root || '/' || file, root * 10 + ext) AS path FROM tries JOIN files USING (file) GROUP BY image_id""")
def resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as images, customers as files in two roots."""
    key, turn = F.col("s_suppkey"), F.col("c_custkey") % 3
    ids = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string"), F.when(key % 4 == 0, ".png").otherwise("")).alias("image_id"))
    ending = F.when(turn == 0, ".jpg").when(turn == 1, ".png").otherwise(".jpeg")
    files = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 2).alias("root"), F.concat(F.lit("s"), F.expr("c_custkey div 3").cast("string"), ending).alias("file"))
    return metadata.resolve(ids, files.withColumn("path", F.concat(F.col("root").cast("string"), F.lit("/"), "file")), ("jpeg", ".JPG", "png"))


@query("""WITH raw AS (SELECT CAST(p_partkey AS VARCHAR) AS image_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS lesion_id, CASE WHEN p_size % 3 = 0 THEN p_type END AS patient_id,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS diagnosis, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_brand END AS site FROM part),
found AS (SELECT CAST(p_partkey AS VARCHAR) AS image_id, '/i/' || p_partkey AS path, 'c' || p_partkey AS checksum, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS width, p_size + 1 AS height FROM part WHERE p_partkey % 4 <> 0),
joined AS (SELECT raw.*, path, checksum, width, height, path IS NOT NULL AND width IS NOT NULL AS ok, coalesce(lesion_id, 'missing_lesion::' || image_id) AS lesion FROM raw LEFT JOIN found USING (image_id))
SELECT image_id, lesion AS lesion_id, lesion_id IS NOT NULL AS lesion_id_available, coalesce(patient_id, 'missing_patient::' || lesion) AS patient_id, patient_id IS NOT NULL AS patient_id_available,
       coalesce(diagnosis, 'unknown_diagnosis') AS diagnosis, coalesce(site, 'unknown_site') AS anatomical_site, 'parts' AS source_dataset, coalesce(path, '') AS path, ok AS image_found,
       CASE WHEN ok THEN checksum ELSE '' END AS checksum, CASE WHEN ok THEN width ELSE 0 END::BIGINT AS width, CASE WHEN ok THEN height ELSE 0 END::BIGINT AS height FROM joined""")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images: some without a file, some with one that cannot be read, some without each field."""
    parts, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    name = key.cast("string").alias("image_id")
    raw = parts.select(name, F.when(size % 5 != 0, F.col("p_brand")).alias("lesion_id"), F.when(size % 3 == 0, F.col("p_type")).alias("patient_id"), F.when(size % 7 != 0, F.col("p_type")).alias("diagnosis"), F.when(size % 11 != 0, F.col("p_brand")).alias("anatomical_site"))
    found = parts.filter(key % 4 != 0).select(name, F.concat(F.lit("/i/"), key.cast("string")).alias("path"), F.concat(F.lit("c"), key.cast("string")).alias("checksum"), F.when(key % 9 != 0, size).alias("width"), (size + 1).alias("height"))
    return metadata.normalise(raw, found, "parts")


@query("""WITH r AS (SELECT list_extract(['train', 'val', 'test'], n_regionkey % 3 + 1) AS split, n_name AS image_id FROM nation),
placed AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY image_id) - 1 AS p, count(*) OVER (PARTITION BY split) AS n FROM r)
SELECT a.split, 'stable' AS pair_label, i.i AS ordinal, a.image_id AS context_image_id, a.image_id AS target_image_id FROM placed a JOIN range(12) i(i) ON i.i % a.n = a.p
UNION ALL SELECT a.split, 'changing', i.i, a.image_id, b.image_id FROM placed a JOIN range(9) i(i) ON (i.i + 12) % a.n = a.p JOIN placed b ON b.split = a.split AND b.p = (a.p + 1) % a.n""")
def next_lesion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(*map(F.lit, ("train", "val", "test")))
    rows = table(spark, sf_dir, "nation").select(F.get(options, F.col("n_regionkey") % 3).alias("split"), F.col("n_name").alias("image_id"))
    stable, changing = pairs.synthetic_pairs(rows, 12, 9)
    shown = [F.col("ordinal").cast("long").alias("ordinal"), F.col("image_id").alias("context_image_id"), F.col("target.image_id").alias("target_image_id")]
    return stable.select("split", F.lit("stable").alias("pair_label"), *shown).unionByName(changing.select("split", F.lit("changing").alias("pair_label"), *shown))


@query("""WITH f AS (SELECT p_partkey, p_size, CASE p_partkey % 3
    WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || lpad(hex(p_size), 8, '0') || lpad(hex(p_size * 3), 8, '0') || '0802000000'
    WHEN 1 THEN '474946383961' || lpad(hex(p_size), 2, '0') || '01' || lpad(hex(p_size), 2, '0') || '00F70000' ELSE '00112233' END AS h FROM part)
SELECT p_partkey, sha256(unhex(h)) AS checksum, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 256 END::BIGINT AS width, CASE p_partkey % 3 WHEN 0 THEN p_size * 3 WHEN 1 THEN p_size END::BIGINT AS height FROM f""")
def probed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG and GIF files made of parts, and bytes that are no image."""
    size, turn = F.col("p_size"), F.col("p_partkey") % 3
    wide = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(size, 8), wide(size * 3, 8), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), wide(size, 2), F.lit("01"), wide(size, 2), F.lit("00F70000"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.when(turn == 0, png).when(turn == 1, gif).otherwise("00112233")).alias("content"))
    return metadata.probe(files).drop("content")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'reject_exact' WHEN p_size % 20 <= 4 THEN 'reject_near' WHEN p_size % 20 <= 10 THEN 'review' WHEN p_partkey % 5 = 0 THEN 'reject_license' ELSE 'keep' END AS verdict FROM part""")
def exclusion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", neardup.exclusion(F.col("p_size") % 20, key % 17 == 0, key % 5 != 0).alias("verdict"))


@query("""SELECT 'run-' || p_partkey AS run_id, p_brand AS model_id, p_retailprice / 10000 AS primary_score, CASE WHEN p_size % 2 = 0 THEN p_name END AS baseline_name,
       CASE WHEN p_size % 3 = 0 THEN p_size / 64.0::DOUBLE END AS baseline_auroc, p_size % 5 = 0 AS collapsed, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END::BIGINT AS stable_pairs FROM part""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics documents made of parts, with fields missing and of the wrong type."""
    size = F.col("p_size")
    best = F.struct(F.when(size % 2 == 0, F.col("p_name")).alias("name"), F.when(size % 3 == 0, size / 64.0).alias("auroc"))
    def document(pairs_used: Column) -> Column:
        return F.to_json(F.struct(F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("run_id"), F.col("p_brand").alias("model_id"), (F.col("p_retailprice") / 10000).alias("primary_score"), F.struct(best.alias("strongest_baseline")).alias("result"), F.struct((size % 5 == 0).alias("collapsed")).alias("representation_health"), F.struct(pairs_used.alias("stable_pairs_used_for_training")).alias("training")))

    said = F.when(size % 8 == 0, document(F.lit(True))).when(size % 4 == 0, document(F.concat(size.cast("string"), F.lit("")))).otherwise(document(size))
    found = runs.summarise(table(spark, sf_dir, "part").select(said.alias("json")))
    return found.select("run_id", "model_id", "primary_score", "baseline_name", "baseline_auroc", "collapsed", "stable_pairs")


# --- stages that are queries of their own ---------------------------------------------------------


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {PICKED} SELECT pair_id, pair_label, CASE WHEN pair_label = 'changing' THEN 1 ELSE 0 END AS label_int, context_image_id FROM manifest WHERE split = 'val'")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of orders, written by split, of which one split is read again."""
    path = _folder(spark, "manifest")
    writers.write_manifest(manifest(spark, sf_dir), path)
    return artifacts.read_manifest(spark, path, "val").select("pair_id", "pair_label", "label_int", "context_image_id")


@query("""SELECT CAST(vec_id AS VARCHAR) AS image_id, len(embedding) AS dimension, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first,
       round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings WHERE label % 2 = 0""")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two models, written as one table; one model's are read, of length 1."""
    rows = table(spark, sf_dir, "embeddings")
    values = {"image_id": F.col("vec_id").cast("string"), "path": F.lit(""), "model_id": F.when(F.col("label") % 2 == 0, "even").otherwise("odd"), "model_name": F.lit("m"), "model_kind": F.lit("table"), "feature_type": F.lit("image"), "dimension": F.size("embedding").cast("long"), "preprocessing_profile": F.lit("square_rgb"), "vector": F.col("embedding")}
    path = _folder(spark, "vectors")
    rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in EMBEDDINGS]).write.partitionBy("model_id").parquet(path)
    found = artifacts.read_vectors(spark, path, "even")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, v: t + v * v))
    return found.select("image_id", F.size("vector").cast("long").alias("dimension"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(length, 6).alias("length"))


@query("""SELECT DISTINCT 'ISIC_' || p_size AS image_id FROM part WHERE p_partkey % 3 <> 0""")
def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids among names of files, some of other kinds."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "OTHER_").otherwise("ISIC_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".PNG"))
    return metadata.ids_in_listing(table(spark, sf_dir, "part").select(name.alias("file")))


@query("""SELECT o_orderpriority AS archive, count(*) AS members, count(*) FILTER (o_orderstatus <> 'F') AS hashed FROM orders GROUP BY 1""")
def archive_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as archives, orders as their members, of which some could be hashed."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("archive"), F.col("o_orderkey").cast("string").alias("member"), "o_orderstatus")
    return images.coverage(rows.select("archive", "member"), rows.filter("o_orderstatus <> 'F'").select("archive", "member"))


@query("""WITH rows AS (
  SELECT d.lang AS model, d.doc_id AS pair_id, CASE WHEN l.quality = 1 THEN 'changing' ELSE 'stable' END AS pair_label, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, pair_label ORDER BY CASE WHEN pair_label = 'stable' THEN -score ELSE score END, CASE WHEN pair_label = 'stable' THEN -pair_id ELSE pair_id END) AS place FROM rows)
SELECT model, pair_id, pair_label, score, CASE WHEN pair_label = 'stable' THEN 'stable_high_prediction_error' ELSE 'changing_low_prediction_error' END AS failure_mode,
       CASE WHEN pair_label = 'stable' THEN 'Did nuisance variation dominate a pair that should remain stable?' ELSE 'Is this changing proxy visually too subtle or poorly matched?' END AS review_question
FROM ranked WHERE place = 1""")
def worst_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst pair of each model and mode, as a trained model's are asked about."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(labels, "doc_id").select(F.col("lang").alias("model"), F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "changing").otherwise("stable").alias("pair_label"), F.col("n_chars").alias("score"), F.col("doc_id").alias("ordinal"))
    return ranking.of_model(ranking.failures(rows, "model", count=1)).drop("ordinal", "place")


@query(f"""WITH {BROKEN}, counts AS (SELECT s.split, count(b.pair_label) FILTER (b.pair_label = 'changing') AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN broken b ON b.split = s.split GROUP BY s.split)
SELECT split, n FROM counts WHERE n < (SELECT count(*) FROM orders) // 12""")
def splits_short_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits with fewer changing pairs than a twelfth of all orders."""
    return checks.short_of_pairs(broken_pairs(spark, sf_dir), table(spark, sf_dir, "orders").count() // 12)


@query(f"""WITH {BROKEN} SELECT count(*) FILTER (split = 'train' AND pair_label = 'stable') AS fitted, count(*) FILTER (split = 'val' AND pair_label = 'stable') AS validated,
       count(*) FILTER (split = 'val' AND pair_label = 'stable') = 0 AS stand_in FROM broken""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.training_rows(broken_pairs(spark, sf_dir))


@query(f"""WITH {PAIRED}, areas AS (
  SELECT split, pair_label = 'changing' AS y, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS r FROM paired),
found AS (SELECT split, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM areas GROUP BY split),
best AS (SELECT split, auroc FROM found WHERE split <> 'test' ORDER BY auroc DESC, split DESC LIMIT 1)
SELECT best.split AS baseline, best.auroc AS baseline_auroc, round(found.auroc - best.auroc, 6) AS delta,
       CASE WHEN found.auroc - best.auroc >= 0.05 THEN 'clear_improvement' WHEN found.auroc - best.auroc >= 0 THEN 'marginal_or_equal' ELSE 'below_baseline' END AS interpretation
FROM found, best WHERE found.split = 'test'""")
def trained_against_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test split as a trained model, the others as baselines: the better one, and by how much the model differs."""
    found = stored(embedding_pair_auroc(spark, sf_dir), "areas")
    rest = found.filter("split <> 'test'").select(F.col("split").alias("model"), "auroc", F.when(F.col("split") == "val", 0).otherwise(1).alias("ordinal"))
    own = found.filter("split = 'test'").select("auroc", F.lit(False).alias("collapsed"))
    return runs.compared(own, metrics.strongest(rest)).withColumn("delta", F.round("delta", 6))


CORPUS = """images AS (
  SELECT CAST(doc_id AS VARCHAR) AS image_id, source AS source_dataset, CASE WHEN doc_id % 17 = 0 THEN CAST(doc_id % 300 AS VARCHAR) ELSE 'd' || doc_id END AS source_record_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'CC-BY-4.0' END AS license,
         CASE WHEN doc_id % 19 = 0 THEN sha256(CAST(doc_id % 300 AS VARCHAR)) ELSE sha256(coalesce(text, '')) END AS sha256_raw,
         CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST('0x' || substr(md5(CAST(doc_id % 997 AS VARCHAR)), 1, 15) AS BIGINT) + doc_id % 4 * 2730 END AS phash FROM documents),
reference AS (SELECT CAST(item_id AS VARCHAR) AS image_id, sha256(CAST(item_id AS VARCHAR)) AS sha256_raw, CAST('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 15) AS BIGINT) AS phash FROM benchmark),
near AS (SELECT i.image_id, min(bit_count(xor(i.phash, r.phash))) AS d FROM images i JOIN reference r ON bit_count(xor(i.phash, r.phash)) <= 10 GROUP BY 1),
judged AS (
  SELECT i.*, n.d, CASE WHEN i.source_record_id IN (SELECT image_id FROM reference) THEN 'source_metadata' WHEN i.sha256_raw IN (SELECT sha256_raw FROM reference) THEN 'exact_hash' WHEN n.d <= 4 THEN 'perceptual_hash'
         WHEN i.license IS NULL OR trim(coalesce(i.source_dataset, '')) = '' THEN 'missing_provenance' WHEN i.phash IS NULL THEN 'not_hashed' WHEN n.d <= 10 THEN 'ambiguous_near_duplicate' END AS reason
  FROM images i LEFT JOIN near n USING (image_id))"""


def corpus_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as images of a corpus, items of the benchmark as the evaluation set."""
    number = lambda c: F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    raw = F.when(i % 19 == 0, F.sha2((i % 300).cast("string"), 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    values = {
        "image_id": i.cast("string"), "source_dataset": F.col("source"), "source_record_id": F.when(i % 17 == 0, (i % 300).cast("string")).otherwise(F.concat(F.lit("d"), i.cast("string"))),
        "source_uri": none, "license": F.when(i % 13 != 0, "CC-BY-4.0"), "local_path": none, "sha256_raw": raw, "sha256_canonical": raw,
        "phash": F.when(i % 23 != 0, number(i % 997) + i % 4 * 2730), "modality": F.lit("unknown"), "diagnosis_label": none, "patient_id": none, "lesion_id": none,
    }
    item = F.col("item_id")
    known = table(spark, sf_dir, "benchmark").select(item.cast("string").alias("image_id"), none.alias("lesion_id"), F.sha2(item.cast("string"), 256).alias("sha256_raw"), none.alias("sha256_canonical"), number(item).alias("phash"))
    return table(spark, sf_dir, "documents").select(*[v.alias(k) for k, v in values.items()]), known


@query(f"""WITH {CORPUS} SELECT image_id, reason AS ham10000_exclusion_reason, CASE WHEN reason = 'ambiguous_near_duplicate' THEN 'pending' WHEN reason IS NOT NULL THEN 'excluded' ELSE 'not_needed' END AS manual_review_status,
       CASE WHEN reason = 'ambiguous_near_duplicate' THEN 'audit_only' WHEN reason IS NOT NULL THEN 'excluded' WHEN CAST('0x' || substr(md5(sha256_raw), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.05 THEN 'pretrain_val' ELSE 'pretrain_train' END AS split FROM judged""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_audit.manifest(*corpus_sides(spark, sf_dir)).select("image_id", "ham10000_exclusion_reason", "manual_review_status", "split")


@query(f"WITH {CORPUS} SELECT reason AS ham10000_exclusion_reason, count(*) AS n FROM judged GROUP BY 1 UNION ALL SELECT 'broken gates', 0")
def corpus_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images each gate turns away, and how many accepted ones break one: none."""
    corpus, known = corpus_sides(spark, sf_dir)
    audited = stored(corpus_audit.manifest(corpus, known), "audited")
    broken = corpus_audit.violations(audited, known).agg(F.lit("broken gates").alias("ham10000_exclusion_reason"), F.count("*").alias("n"))
    return corpus_audit.report(audited).groupBy(F.col("reason").alias("ham10000_exclusion_reason")).agg(F.sum("n").alias("n")).unionByName(broken)
