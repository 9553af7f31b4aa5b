"""python -m pairforge COMMAND: the stages of a run, one by one."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge import config as settings
from pairforge.operators import corpus_audit, neardup, runs
from pairforge.plans import pipelines
from pairforge.sinks import writers
from pairforge.sources import artifacts


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    texts = {
        "audit": "describe the records", "manifest": "build the pairs and their variants", "embed": "make the vectors of all images",
        "baselines": "score pairs by pixels and vectors", "train": "fit and score the predictor", "benchmark": "check a finished run",
        "demo": "bundle a few pairs to look at", "all": "audit, manifest, vectors, baselines and a demo", "duplicates": "images of archives like the dataset's",
    }
    for name, text in texts.items():
        own = commands.add_parser(name, help=text)
        own.add_argument("config")
        own.add_argument("--run-id")
        if name in ("baselines", "train"):
            own.add_argument("--vectors", help="table of image_id, model_id and vector; else the run's own are made")
        if name == "train":
            own.add_argument("--dry-run", action="store_true")
        if name == "benchmark":
            own.add_argument("--least", type=float, default=0.95)
            own.add_argument("--override", action="store_true")
        if name in ("demo", "all"):
            own.add_argument("--out", help="folder of the bundle; the run's own without it")
        if name == "duplicates":
            own.add_argument("archives")
            own.add_argument("--most", type=int, default=10)
    sweep = commands.add_parser("sweep", help="compare runs below a folder")
    sweep.add_argument("root")
    summary = commands.add_parser("summary", help="one line of JSON for each run below a folder")
    summary.add_argument("root")
    claims = commands.add_parser("claims", help="hold the scores of runs against a CSV of run_id and value")
    claims.add_argument("root")
    claims.add_argument("expected")
    claims.add_argument("--tolerance", type=float, default=5e-4)
    overlap = commands.add_parser("overlap", help="near duplicates between two tables of id and hash")
    overlap.add_argument("left")
    overlap.add_argument("right")
    overlap.add_argument("--most", type=int, default=10)
    corpus = commands.add_parser("corpus", help="audit a table of images against a reference set; the manifest and its report")
    corpus.add_argument("images")
    corpus.add_argument("reference")
    corpus.add_argument("out")
    corpus.add_argument("--validation", type=float, default=0.05)
    corpus.add_argument("--cleared", help="table of the image_id of doubtful images that were looked at")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pairforge").getOrCreate()
    if args.command == "sweep":
        rows = runs.summarise(artifacts.read_runs(spark, args.root)).withColumn("family", F.regexp_replace("run_id", r"-seed\d+$", ""))
        say(runs.sweep(rows, "family", "primary_score").orderBy("family"))
        return 0
    if args.command == "summary":
        say(runs.summarise(artifacts.read_runs(spark, args.root)))
        return 0
    if args.command == "claims":
        observed = runs.summarise(artifacts.read_runs(spark, args.root)).select("run_id", F.col("primary_score").alias("value"))
        expected = spark.read.csv(args.expected, header=True, schema="run_id string, value double")
        found = runs.check_claims(expected, observed, tolerance=args.tolerance)
        say(found.orderBy("run_id"))
        return int(found.filter("status = 'FAIL'").limit(1).count())
    if args.command == "overlap":
        found = neardup.hamming_join(spark.read.parquet(args.left), spark.read.parquet(args.right), args.most)
        neardup.distance_bands(found).show()
        return 0
    if args.command == "corpus":
        return audit_corpus(spark, args)
    config = settings.load(args.config, run_id=args.run_id)
    with writers.run_lock(Path(config.run_dir)):
        return run(spark, config, args)


def say(rows: DataFrame) -> None:
    """Every row as a line of JSON, a partition at a time."""
    for line in rows.toJSON().toLocalIterator():
        print(line)


def audit_corpus(spark: SparkSession, args: argparse.Namespace) -> int:
    """Write the manifest and its report; 1 if an accepted image breaks a gate."""
    images, reference = spark.read.parquet(args.images), spark.read.parquet(args.reference)
    cleared = spark.read.parquet(args.cleared) if args.cleared else None
    writers.write_table(corpus_audit.manifest(images, reference, args.validation, cleared), f"{args.out}/manifest")
    audited = spark.read.parquet(f"{args.out}/manifest")
    writers.write_table(corpus_audit.report(audited), f"{args.out}/report")
    say(spark.read.parquet(f"{args.out}/report").orderBy("source_dataset", "split", "reason"))
    return int(corpus_audit.violations(audited, reference).limit(1).count())


def run(spark: SparkSession, config: settings.Config, args: argparse.Namespace) -> int:
    """One command over one run."""
    if args.command == "audit":
        print(json.dumps(pipelines.run_audit(spark, config), indent=2, sort_keys=True, default=str))
    elif args.command == "manifest":
        pipelines.build_manifest(spark, config).groupBy("split", "pair_label").count().show()
    elif args.command == "benchmark":
        gate = pipelines.benchmark(spark, config, args.least, args.override)
        print(json.dumps(gate))
        return int(not gate["passed"])
    elif args.command == "train" and args.dry_run:
        print(config)
    elif args.command == "duplicates":
        neardup.distance_bands(pipelines.near_duplicates(spark, config, args.archives, args.most)).show()
    else:
        manifest = pipelines.build_manifest(spark, config)
        if args.command == "demo":
            print(pipelines.demo(spark, config, args.out or f"{config.run_dir}/demo"))
            return 0
        own = getattr(args, "vectors", None) or f"{config.run_dir}/embeddings"
        if own == f"{config.run_dir}/embeddings":
            pipelines.run_embeddings(spark, config, manifest).groupBy("model_id", "dimension").count().show()
        if args.command in ("baselines", "all"):
            frames = {m.model_id: artifacts.read_vectors(spark, own, m.model_id) for m in config.embedding_models}
            far = pipelines.image_distances(manifest.filter("split = 'test'"), pipelines.run_images(spark, config, manifest), config.preprocessing.image_size)
            pipelines.run_baselines(spark, config, manifest, frames, distances=far).show(truncate=False)
        if args.command == "all":
            print(pipelines.demo(spark, config, args.out or f"{config.run_dir}/demo"))
        if args.command == "train":
            model = config.training.embedding_model_id or config.embedding_models[0].model_id
            pipelines.train(spark, config, manifest, artifacts.read_vectors(spark, own, model))
    return 0


if __name__ == "__main__":
    sys.exit(main())
