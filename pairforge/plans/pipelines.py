"""The stages of a run: audit, manifest, embeddings, baselines, training, benchmark.

A stage reads the tables of the one before and writes its own below the run's folder, so it can
be run alone; a table that exists is read, not made again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.config import Config, Model
from pairforge.functions import pixels
from pairforge.functions import text as names
from pairforge.functions.vectors import cosine_distance, normalised
from pairforge.operators import audit, checks, metrics, neardup, pairs, predictor, ranking, runs, split
from pairforge.schema import EMBEDDINGS, PAIRS, RECORDS, SEED_OFFSETS, SPLITS, SYNTHETIC_CHANGING, SYNTHETIC_STABLE
from pairforge.sinks import writers
from pairforge.sinks.events import stage
from pairforge.sinks.files import put
from pairforge.sources import artifacts, images, metadata

BOUNDARY = "research use only; not diagnostic, not medical advice, and not validated for patient use"

#: The order of a split's pairs: stable ones first, each label by number.
MANIFEST_ORDER = ("label_int", "pair_id")


def _made(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def load_records(spark: SparkSession, config: Config) -> DataFrame:
    """The dataset's records, written once; records of a fixture carry their split and have pictures of their own."""
    path = f"{config.run_dir}/records"
    if not _made(spark, path):
        if config.fixture is not None:
            rows = metadata.synthetic_records(spark, config.fixture.lesions_per_split, config.fixture.source_dataset)
            rows = images.write_synthetic(rows, f"{_place(config)}/fixture_images", config.fixture.image_size)
        else:
            d = config.dataset
            rows = metadata.load_records(spark, d.metadata_csv, d.image_roots, d.image_extensions, d.name, d.max_records)
        writers.write_table(rows, path)
    return spark.read.parquet(path)


def _place(config: Config) -> str:
    """The run's folder as tasks write to it."""
    return config.run_dir if "://" in config.run_dir else str(Path(config.run_dir).resolve())


def run_audit(spark: SparkSession, config: Config) -> dict[str, Any]:
    """The audit of records alone; missing images are reported, not refused."""
    found = audit.audit(load_records(spark, config)) | {"run_id": config.run_id, "tier": config.tier, "clinical_boundary": BOUNDARY}
    writers.write_document(Path(config.run_dir) / "audit.json", found)
    return found


def _digest(config: Config) -> str:
    """What a manifest depends on, in short."""
    parts = (config.run_id, config.seed, config.fixture, config.dataset, config.preprocessing)
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def draft_pairs(spark: SparkSession, config: Config, records: DataFrame) -> DataFrame:
    """Split, pair and check, before anything is made: manifest rows, with the families and ordinal of stable ones."""
    wanted = config.dataset or config.fixture
    n_stable, n_changing = wanted.stable_pairs_per_split, wanted.changing_pairs_per_split
    checks.validate(checks.record_violations(records))
    if config.dataset is not None:
        parts = config.dataset.split
        assigned = split.split_records(records, config.seed, parts.train, parts.val)
        base, held_out = config.dataset.nuisance_severity, config.dataset.nuisance_severity_eval
    else:
        assigned, base, held_out = records, "mild", None
    columns = [f.name for f in RECORDS]
    writers.write_table(assigned.select("split", *columns), f"{config.run_dir}/split_records")
    assigned = spark.read.parquet(f"{config.run_dir}/split_records")
    checks.validate(checks.split_violations(assigned, n_stable, n_changing if config.dataset else 0) if config.dataset else checks.split_violations(assigned, 0, 0))
    families = names.families(names.severity(F.col("split"), base, held_out))
    if config.dataset is not None:
        writers.write_table(pairs.positions(assigned), f"{config.run_dir}/placed_records")
        placed = spark.read.parquet(f"{config.run_dir}/placed_records")
        anchors = pairs.stable_anchors(placed, n_stable).select("*", F.struct(*columns).alias("target"), F.col("k").alias("ordinal"))
        moved = pairs.changing_pairs(placed, n_stable, n_changing, config.dataset.changing_pair_policy != "fallback")
        name, digits, reason, moved_reason = "%s_public_{}_%04d", 4, names.stable_reason(families), F.col("reason")
    else:
        anchors, moved = pairs.synthetic_pairs(assigned, n_stable, n_changing)
        name, digits, reason, moved_reason = "%s_{}_%03d", 3, F.lit(SYNTHETIC_STABLE), F.lit(SYNTHETIC_CHANGING)
    suffix = F.format_string(f"%s_stable_%0{digits}d", "image_id", F.col("ordinal").cast("int"))
    target = F.concat(F.lit(f"{_place(config)}/stable_variants/"), "split", F.lit("/"), suffix, F.lit(".png"))
    profile = config.preprocessing.profile
    none = F.lit('{"family": "none", "severity": "none"}')
    stable = pairs.pair_rows(anchors, "stable", reason, F.lit(None), suffix, target, profile, name)
    changing = pairs.pair_rows(moved, "changing", moved_reason, none, F.col("target.image_id"), F.col("target.path"), profile, name)
    ordinal = F.regexp_extract("pair_id", r"(\d+)$", 1).cast("int").alias("ordinal")
    writers.write_table(stable.unionByName(changing).select("*", ordinal, families.alias("families")), f"{config.run_dir}/draft")
    draft = spark.read.parquet(f"{config.run_dir}/draft")
    checks.validate(checks.manifest_violations(draft))
    lacking = [r.asDict() for r in checks.short_of_pairs(draft, n_changing).collect()]
    if lacking:
        raise checks.InvalidData(f"the policy could not produce {n_changing} changing pairs for {lacking}; ask for fewer or relax it")
    return draft


def build_manifest(spark: SparkSession, config: Config) -> DataFrame:
    """Split the records by group, pair them, check the pairs, make the stable variants; write manifest, review subset and audit.

    Pairs are checked before the manifest is there, so a failed build leaves none. A manifest of
    another configuration under the same run is refused.
    """
    path, digest = f"{config.run_dir}/manifest", Path(config.run_dir) / "manifest.digest"
    if _made(spark, path):
        if not digest.exists() or digest.read_text() != _digest(config):
            raise checks.InvalidData(f"{path} is of another configuration; name another run")
        return artifacts.read_manifest(spark, path)
    records = load_records(spark, config)
    with stage("manifest", Path(config.run_dir), spark=spark, run_id=config.run_id):
        draft = draft_pairs(spark, config, records)
        known = images.pictures(records, images.images_in(spark, image_folders(config)))
        made = stable_variants(draft.filter("pair_label = 'stable'"), known, config.preprocessing.image_size, config.seed)
        writers.write_table(made, f"{config.run_dir}/variants")
        made = spark.read.parquet(f"{config.run_dir}/variants")
        lost = draft.filter("pair_label = 'stable'").join(made, "pair_id", "left_anti").select("context_image_id").limit(5).collect()
        if lost:
            raise checks.InvalidData(f"no variant could be made of {[r.context_image_id for r in lost]}")
        taken = {"augmentation_recipe_json": "recipe_json", "target_checksum": "checksum", "target_width": "width", "target_height": "height"}
        rows = draft.join(made, "pair_id", "left").withColumns({c: F.coalesce(v, c) for c, v in taken.items()})
        digest.parent.mkdir(parents=True, exist_ok=True)
        digest.write_text(_digest(config))
        writers.write_manifest(rows.select(*[f.name for f in PAIRS]), path)
    manifest = artifacts.read_manifest(spark, path)
    writers.write_review(manifest, f"{config.run_dir}/review")
    # Whole lists beside the audit, which has the first of each.
    writers.write_table(audit.leakage(manifest), f"{config.run_dir}/leakage")
    writers.write_table(audit.value_counts(records), f"{config.run_dir}/value_counts")
    writers.write_document(Path(config.run_dir) / "audit.json", audit.audit(records, manifest) | {"run_id": config.run_id, "tier": config.tier, "clinical_boundary": BOUNDARY})
    writers.snapshot(Path(config.run_dir), config, spark)
    writers.append_log(Path(config.run_dir), "data_audit.log", f"{config.tier} manifest built, checks passed")
    return manifest


def image_folders(config: Config) -> list[str]:
    return list(config.dataset.image_roots) if config.dataset is not None else [f"{_place(config)}/fixture_images"]


def run_images(spark: SparkSession, config: Config, manifest: DataFrame, oriented: bool = False) -> DataFrame:
    """(image_id, image, orientation) of all contexts and targets of a manifest, variants included."""
    found = images.images_in(spark, [*image_folders(config), f"{_place(config)}/stable_variants"], oriented)
    return images.pictures(audit.images_of(manifest), found)


#: By kind of model: what makes the vectors of images. Add others with register().
EMBEDDERS: dict[str, Callable[[DataFrame, Config, Model], DataFrame]] = {}


def register(kind: str, embed: Callable[[DataFrame, Config, Model], DataFrame]) -> None:
    """Let ``embed(images, config, model)`` make (image_id, vector) of (image_id, image, orientation) for models of a kind."""
    EMBEDDERS[kind] = embed


def embed_images(spark: SparkSession, images_: DataFrame, size: int) -> DataFrame:
    """(image_id, vector) of distinct images (image_id, image and, if there is one, orientation)."""
    turned = images_ if "orientation" in images_.columns else images_.withColumn("orientation", F.lit(1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [pixels.features(pixels.square(pixels.from_row(row, int(turn)), size)) for row, turn in zip(b["image"], b["orientation"], strict=True)]
            yield pd.DataFrame({"image_id": b["image_id"], "vector": [v.tolist() for v in made]})

    return turned.select("image_id", "image", "orientation").mapInPandas(run, "image_id string, vector array<float>")


register("color_texture", lambda images_, config, model: embed_images(images_.sparkSession, images_, config.preprocessing.image_size))


def run_embeddings(spark: SparkSession, config: Config, manifest: DataFrame) -> DataFrame:
    """The vectors of every model of the configuration, for all images of a manifest, in one table; made once."""
    path = f"{config.run_dir}/embeddings"
    if not _made(spark, path):
        lacking = sorted({m.kind for m in config.embedding_models} - set(EMBEDDERS))
        if lacking:
            raise ValueError(f"no embedder for {lacking}: register() one, or read its vectors from a table")
        known, paths = run_images(spark, config, manifest, oriented=True), audit.images_of(manifest)
        rows = None
        for m in config.embedding_models:
            made = EMBEDDERS[m.kind](known, config, m).join(paths, "image_id")
            named = {"model_id": m.model_id, "model_name": m.model_name, "model_kind": m.kind, "feature_type": "image", "preprocessing_profile": config.preprocessing.profile}
            made = made.withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("dimension", F.size("vector").cast("long"))
            made = made.select(*[F.col(f.name).cast(f.dataType) for f in EMBEDDINGS])
            rows = made if rows is None else rows.unionByName(made)
        with stage("embeddings", Path(config.run_dir), spark=spark, run_id=config.run_id):
            rows.write.partitionBy("model_id").parquet(path)
    found = spark.read.schema(EMBEDDINGS).parquet(path)
    uneven = found.groupBy("model_id").agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).filter("least <> most").limit(1).collect()
    if uneven:
        raise checks.InvalidData(f"vectors of {uneven[0].model_id} differ in length")
    return found


def stable_variants(anchors: DataFrame, known: DataFrame, size: int, seed: int) -> DataFrame:
    """Make and write the variants of stable pairs (pair_id, context_image_id, families, ordinal, target_path).

    Returns pair_id, checksum, width, height and recipe_json. Each pair has a generator of its
    own, seeded by the run and its id, so variants are made in parallel, do not depend on each
    other, and come out the same when a lost task is run again. Sequential draws over all pairs,
    which depend on pixel counts, are not reproduced.
    """
    rows = anchors.select("pair_id", "context_image_id", "families", "ordinal", "target_path").join(known.select(F.col("image_id").alias("context_image_id"), "image"), "context_image_id")
    keyed = rows.select("pair_id", "families", "ordinal", "target_path", "image", F.xxhash64(F.lit(seed + SEED_OFFSETS["pairs"]), "pair_id").alias("seed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                made, recipe = pixels.variant(pixels.from_row(r.image), size, list(r.families), int(r.ordinal), np.random.default_rng(r.seed % 2**63))
                data = pixels.png(made)
                put(r.target_path, data)
                out.append((r.pair_id, hashlib.sha256(data).hexdigest(), made.shape[1], made.shape[0], json.dumps(recipe)))
            yield pd.DataFrame(out, columns=["pair_id", "checksum", "width", "height", "recipe_json"])

    return keyed.mapInPandas(run, "pair_id string, checksum string, width long, height long, recipe_json string")


def image_distances(pairs_: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """pair_id, pixel and ssim of each pair; both distances from one decoding of each side."""
    context = known.select(F.col("image_id").alias("context_image_id"), F.col("image").alias("a"))
    target = known.select(F.col("image_id").alias("target_image_id"), F.col("image").alias("b"))
    rows = pairs_.select("pair_id", "context_image_id", "target_image_id").join(context, "context_image_id").join(target, "target_image_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [(pixels.square(pixels.from_row(x), size), pixels.square(pixels.from_row(y), size)) for x, y in zip(b["a"], b["b"], strict=True)]
            yield pd.DataFrame({"pair_id": b["pair_id"], "pixel": [pixels.pixel_distance(*p) for p in both], "ssim": [pixels.ssim_distance(*p) for p in both]})

    return rows.select("pair_id", "a", "b").mapInPandas(run, "pair_id string, pixel double, ssim double")


def vector_scores(pairs_: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Scores of pairs by the cosine distance of their vectors."""
    joined = predictor.pair_vectors(pairs_, vectors)
    far = cosine_distance(normalised(F.col("x")), normalised(F.col("y")))
    return joined.select(F.lit(model).alias("model"), "pair_id", "split", "pair_label", "label_int", far.alias("score"))


def baseline_seeds(config: Config, models: list[str]) -> dict[str, int]:
    """Each baseline's own seed: the image distances have theirs, embeddings follow one another."""
    fixed = {m: config.seed + SEED_OFFSETS[m] for m in ("pixel", "ssim") if m in models}
    return fixed | {m: config.seed + SEED_OFFSETS["embedding"] + i for i, m in enumerate(m for m in models if m not in fixed)}


def evaluate(scores: DataFrame, config: Config, seed: int | dict[str, int]) -> DataFrame:
    """The metric summary of each model, with intervals from a sequential generator."""
    broken = metrics.invalid_groups(scores, ["model"]).limit(5).collect()
    if broken:
        raise checks.InvalidData(f"no metric is defined for {[r.model for r in broken]}")
    m = config.metrics
    found = metrics.metric_summary(scores, ["model"], m.fixed_tpr)
    ends = metrics.bootstrap_sequential(scores, ["model"], MANIFEST_ORDER, m.bootstrap_samples, m.ci_level, seed)
    return found.join(ends, "model").withColumn("bootstrap_samples", F.lit(m.bootstrap_samples))


def run_baselines(spark: SparkSession, config: Config, manifest: DataFrame, vectors: dict[str, DataFrame], part: str = "test", distances: DataFrame | None = None) -> DataFrame:
    """Metrics of each baseline on one split; writes scores, metrics and the worst pairs."""
    rows = manifest.filter(F.col("split") == part)
    scores = None
    if distances is not None:
        named = F.explode(F.array(F.struct(F.lit("pixel").alias("model"), F.col("pixel").alias("score")), F.struct(F.lit("ssim").alias("model"), F.col("ssim").alias("score"))))
        scores = rows.join(distances, "pair_id").select(named.alias("s"), "pair_id", "split", "pair_label", "label_int").select("s.model", "pair_id", "split", "pair_label", "label_int", "s.score")
    for name, frame in vectors.items():
        own = vector_scores(rows, frame, name)
        scores = own if scores is None else scores.unionByName(own)
    if scores is None:
        raise ValueError("no baseline to evaluate")
    path = f"{config.run_dir}/baseline_scores"
    writers.write_table(scores, path)
    scores = spark.read.parquet(path)
    models = [*(["pixel", "ssim"] if distances is not None else []), *vectors]
    found = evaluate(scores, config, baseline_seeds(config, models))
    # Pairs of one label stand in a manifest by the number in their id.
    worst = ranking.failures(scores.withColumn("ordinal", F.regexp_extract("pair_id", r"(\d+)$", 1).cast("long")), "model").drop("ordinal")
    table = sorted((r.asDict() for r in found.collect()), key=lambda r: models.index(r["model"]))
    writers.write_document(Path(config.run_dir) / "baselines.json", {"run_id": config.run_id, "split": part, "baselines": table, "failures": [r.asDict() for r in worst.collect()], "clinical_boundary": BOUNDARY})
    best = max(table, key=lambda r: r["auroc"])
    facts = {"run_id": config.run_id, "split": part, "strongest baseline": f"{best['model']} ({best['auroc']:.4f})"} | {r["model"]: f"{r['auroc']:.4f}" for r in table}
    (Path(config.run_dir) / "baseline_card.md").write_text(writers.model_card("baselines", facts, BOUNDARY), encoding="utf-8")
    (Path(config.run_dir) / "baselines.svg").write_text(writers.bar_chart([(r["model"], r["auroc"]) for r in table]), encoding="utf-8")
    writers.append_log(Path(config.run_dir), "train.log", "baselines only: nothing was trained")
    writers.append_log(Path(config.run_dir), "eval.log", f"evaluated {config.tier} baselines on {part} split")
    return spark.createDataFrame(table)


def train(spark: SparkSession, config: Config, manifest: DataFrame, vectors: DataFrame) -> dict[str, Any]:
    """Fit on stable training pairs, score all splits, compare with the baselines, write the artifacts."""
    joined = predictor.pair_vectors(manifest, vectors)
    stable = joined.filter("pair_label = 'stable'")
    fit_rows, val_rows = stable.filter("split = 'train'"), stable.filter("split = 'val'")
    if not fit_rows.limit(1).count():
        raise checks.InvalidData("no stable training pair")
    t = config.training
    used = fit_rows.count()
    if t.predictor == "ridge":
        dim = fit_rows.select(F.size("x")).first()[0]
        state = predictor.ridge(fit_rows, t.weight_decay * used, dim)
    else:
        settings = {"seed": config.seed, "epochs": t.epochs, "batch": t.batch_size, "rate": t.learning_rate, "decay": t.weight_decay}
        wide = {"hidden": t.hidden_dim, "optimizer": t.optimizer} if t.predictor == "mlp" else {}
        held_out = val_rows if val_rows.limit(1).count() else fit_rows
        if max(used, held_out.count()) <= predictor.MOST_PAIRS:
            x, y = predictor.matrices(fit_rows)
            val = predictor.matrices(held_out)
            state = predictor.fit_linear(x, y, val, **settings) if t.predictor == "linear" else predictor.fit_mlp(x, y, val, **settings, **wide)
        else:  # too many to gather: the same steps over other batches, as hashes and not a generator's stream put pairs in order
            state = predictor.fit_stored(fit_rows, held_out, t.predictor, **settings, **wide)
    path = f"{config.run_dir}/latents"
    # Train, val, test: pairs of one split are read together.
    order = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")).alias("split_at")
    ordered = predictor.score(joined, state).withColumn("split_at", order).repartitionByRange("split_at", "pair_id").sortWithinPartitions("split_at", "pair_id")
    writers.write_table(ordered.drop("split_at"), path)
    scored = spark.read.parquet(path)
    health = metrics.collapse_checks(scored).first().asDict()
    table = {}
    for part in ("train", "val", "test"):
        rows = scored.filter(F.col("split") == part).withColumn("model", F.lit(t.model_id))
        table[part] = evaluate(rows, config, config.seed + SEED_OFFSETS[part]).first().asDict()
    writers.write_checkpoint(Path(config.run_dir) / "checkpoint.npz", state, {"model_id": t.model_id, "embedding_model_id": t.embedding_model_id or ""})
    result = {"run_id": config.run_id, "tier": config.tier, "model_id": t.model_id, "primary_metric": "test_auroc", "primary_score": table["test"]["auroc"], "metrics": table, "representation_health": health, "history": state["history"], "training": {"stable_pairs_used_for_training": used}}
    scores_path = f"{config.run_dir}/baseline_scores"
    if _made(spark, scores_path):
        order = F.when(F.col("model") == "pixel", 0).when(F.col("model") == "ssim", 1).otherwise(2)
        best = metrics.strongest(metrics.auroc(spark.read.parquet(scores_path), ["model"]).withColumn("ordinal", order))
        own = spark.createDataFrame([(float(table["test"]["auroc"]), bool(health["collapsed"]))], "auroc double, collapsed boolean")
        found = runs.compared(own, best).first()
        result["result"] = {"strongest_baseline": {"name": found.baseline, "auroc": found.baseline_auroc}, "delta_auroc_vs_strongest_baseline": found.delta, "interpretation": found.interpretation}
    numbered = scored.filter("split = 'test'").withColumns({"model": F.lit(t.model_id), "ordinal": F.regexp_extract("pair_id", r"(\d+)$", 1).cast("long")})
    worst = ranking.of_model(ranking.failures(numbered.select("model", "pair_id", "pair_label", "score", "ordinal"), "model").drop("ordinal"))
    result["failures"] = [r.asDict() for r in worst.collect()]
    writers.write_document(Path(config.run_dir) / "metrics.json", result)
    card = writers.model_card(t.model_id, {k: result[k] for k in ("run_id", "primary_metric", "primary_score")}, BOUNDARY)
    (Path(config.run_dir) / "model_card.md").write_text(card, encoding="utf-8")
    top = scored.filter("split = 'test'").orderBy("pair_id").limit(24).select("pair_id", "score").collect()
    (Path(config.run_dir) / "scores.svg").write_text(writers.bar_chart([(r.pair_id, r.score) for r in top]), encoding="utf-8")
    return result


#: Files and tables that a finished run has.
REQUIRED = ("records", "manifest", "review", "audit.json", "baseline_scores", "baselines.json")


def benchmark(spark: SparkSession, config: Config, least: float = 0.95, override: bool = False) -> dict[str, Any]:
    """Whether a run is complete and its strongest score good enough."""
    missing = [name for name in REQUIRED if not (Path(config.run_dir) / name).exists()]
    if missing:
        raise FileNotFoundError(f"{config.run_dir} lacks {missing}")
    scores = spark.read.parquet(f"{config.run_dir}/baseline_scores")
    gate = runs.accepted(metrics.auroc(scores, ["model"]), least, override).first().asDict()
    writers.write_document(Path(config.run_dir) / "acceptance.json", gate)
    return gate


def near_duplicates(spark: SparkSession, config: Config, archives: str, most: int = 10) -> DataFrame:
    """Images of ZIP archives that look like the dataset's: hash both, join, write pairs and coverage."""
    records = load_records(spark, config)
    own = images.perceptual_hashes(images.pictures(records, images.images_in(spark, image_folders(config))))
    place = f"{_place(config)}/archive_images"
    members = images.archive_members(spark, archives)
    writers.write_table(images.extract(members, place), f"{config.run_dir}/archive_members")
    members = spark.read.parquet(f"{config.run_dir}/archive_members")
    named = members.filter("path is not null").select(F.concat_ws("/", "archive", "member").alias("image_id"), "archive", "position", "member", "path")
    other = images.perceptual_hashes(images.pictures(named, images.images_in(spark, [place])))
    writers.write_table(other, f"{config.run_dir}/archive_hashes")
    other = spark.read.parquet(f"{config.run_dir}/archive_hashes")
    # Copies as classes with their members first, which stay few however often an image comes; then all pairs, as the CSV has them.
    writers.write_table(neardup.hamming_classes(own, other, most), f"{config.run_dir}/near_duplicate_classes")
    writers.write_table(neardup.class_members(own, other), f"{config.run_dir}/near_duplicate_members")
    found = neardup.hamming_join(own, other, most)
    covered = images.coverage(members, named.join(other.select(F.col("id").alias("image_id")), "image_id", "left_semi"))
    placed = found.join(named.select(F.col("image_id").alias("b_id"), "archive", "position"), "b_id")
    writers.write_near_duplicates(placed, covered, most, f"{_place(config)}/near_duplicates")
    return found


def demo(spark: SparkSession, config: Config, folder: str, count: int = 4) -> Path:
    """A bundle of the first test pairs and the baselines' scores, for people to look at."""
    manifest = artifacts.read_manifest(spark, f"{config.run_dir}/manifest", "test")
    shown = manifest.orderBy(*MANIFEST_ORDER).limit(count)
    columns = ["pair_id", "pair_label", "context_image_id", "target_image_id", "context_path", "target_path", "source_dataset", "anatomical_site", "diagnosis", "preprocessing_profile"]
    rows = [r.asDict() for r in shown.select(*columns).collect()]
    scores = spark.read.parquet(f"{config.run_dir}/baseline_scores").join(shown.select("pair_id"), "pair_id", "left_semi")
    worst = ranking.failures(spark.read.parquet(f"{config.run_dir}/baseline_scores").withColumn("ordinal", F.regexp_extract("pair_id", r"(\d+)$", 1).cast("long")), "model", count=1)
    charts = [r.asDict() for r in scores.select("model", "pair_id", "score").orderBy("model", "pair_id").collect()]
    writers.write_demo(Path(folder), config.run_id, rows, charts, [r.asDict() for r in worst.select("model", "failure_mode", "pair_id", "score", "review_question").orderBy("model", "failure_mode").collect()])
    return Path(folder) / "demo.json"
