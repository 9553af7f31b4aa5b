"""Sources, sinks, images, predictors and whole runs on small files."""

import hashlib
import json
import struct
import zipfile
import zlib
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge import config as C
from pairforge.functions import headers, pixels
from pairforge.operators import checks, predictor
from pairforge.plans import pipelines
from pairforge.sinks import events, writers
from pairforge.sources import artifacts, images, metadata
from pairforge.streaming import progress


def png(pixels_: np.ndarray) -> bytes:
    height, width, _ = pixels_.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels_)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(i: int, size: int = 48) -> np.ndarray:
    y, x = np.mgrid[0:size, 0:size]
    out = np.full((size, size, 3), (200, 160 + i % 5, 140), np.uint8)
    out[(x - 10 - i % 20) ** 2 + (y - 24) ** 2 < 60 + 3 * i] = (90, 40 + 3 * (i % 30), 30)
    return out


@pytest.fixture
def dataset(tmp_path):
    (tmp_path / "images").mkdir()
    lines = ["Lesion_ID , image_id,dx,localization"]
    for i in range(60):
        lines.append(f"H{i // 2:03d},I{i:03d},{['nv', 'bkl'][i // 2 % 2]},{['back', 'arm', 'leg'][i // 4 % 3]}")
        (tmp_path / "images" / f"I{i:03d}.png").write_bytes(png(picture(i)))
    (tmp_path / "meta.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def settings(folder, **more):
    data = C.Dataset("set", str(folder / "meta.csv"), (str(folder / "images"),), ("jpg", "png"), 4, 4, C.Fractions(0.6, 0.2, 0.2))
    return C.Config("run1", str(folder / "runs"), 5, dataset=data, metrics=C.Metrics(50), preprocessing=C.Preprocessing(image_size=32), training=C.Training(epochs=20), **more)


def test_records(spark, dataset):
    rows = {r.image_id: r for r in metadata.load_records(spark, str(dataset / "meta.csv"), [str(dataset / "images")], ["jpg", "png"], "set").collect()}
    r = rows["I005"]
    assert len(rows) == 60 and (r.lesion_id, r.patient_id, r.diagnosis, r.width, r.height, r.image_found) == ("H002", "missing_patient::H002", "nv", 48, 48, True)
    assert len(r.checksum) == 64 and r.path.endswith("/I005.png")


def test_aliases_sentinels_and_missing_images(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.jpeg").write_bytes(b"not an image")
    (tmp_path / "b" / "x.png").write_bytes(png(picture(1)))
    (tmp_path / "b" / "y.png").write_bytes(png(picture(2)))
    (tmp_path / "m.csv").write_text(" ISIC_ID ,DX,site\nx,,arm\ny.png, mel ,\nz,,\n")
    rows = {r.image_id: r for r in metadata.load_records(spark, str(tmp_path / "m.csv"), [str(tmp_path / "a"), str(tmp_path / "b")], ["jpeg", "png"], "s").collect()}
    # The first root wins over the first extension; an unreadable file keeps its path.
    assert (rows["x"].image_found, rows["x"].path.endswith("/a/x.jpeg"), rows["x"].lesion_id) == (False, True, "missing_lesion::x")
    assert (rows["y.png"].image_found, rows["y.png"].diagnosis, rows["y.png"].anatomical_site) == (True, "mel", "unknown_site")
    assert (rows["z"].image_found, rows["z"].path, rows["z"].diagnosis, rows["z"].patient_id) == (False, "", "unknown_diagnosis", "missing_patient::missing_lesion::z")
    with pytest.raises(checks.InvalidData, match="image present"):
        checks.validate(checks.record_violations(metadata.load_records(spark, str(tmp_path / "m.csv"), [str(tmp_path / "b")], ["png"], "s")))


def test_csv_limits(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_id,dx\na,1,extra\nb\nc,3\n")
    rows = metadata.read_csv(spark, str(tmp_path / "m.csv"), 2).collect()
    assert [tuple(r) for r in rows] == [("a", "1"), ("b", "")]
    (tmp_path / "e.csv").write_text("image_id,dx\n")
    with pytest.raises(ValueError):
        metadata.read_csv(spark, str(tmp_path / "e.csv"))


def test_jpeg_size_is_found_in_its_frame_header(spark):
    app = b"\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
    frame = b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 123, 456) + b"\x03" + b"\x01\x22\x00\x02\x11\x01\x03\x11\x01"
    df = spark.createDataFrame([("j", bytearray(b"\xff\xd8" + app + frame)), ("bad", bytearray(b"\xff\xd8"))], "path string, content binary")
    got = {r.path: (r.width, r.height) for r in metadata.probe(df).collect()}
    assert got == {"j": (456, 123), "bad": (None, None)}


def exif(orientation: int, padding: int = 0) -> bytes:
    tiff = b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, orientation, 0)
    body = b"Exif\0\0" + tiff
    app = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return app + (b"\xff\xe2" + struct.pack(">H", 60_002) + b"\xff\xc0\0\x11" * 15_000) * padding


def test_jpeg_headers_behind_long_metadata():
    for marker in (0xC0, 0xC1, 0xC2, 0xC5, 0xC9, 0xCF):
        frame = bytes([0xFF, marker]) + b"\x00\x11\x0c" + struct.pack(">HH", 123, 456) + b"\x03" + bytes(9)
        data = b"\xff\xd8" + exif(6, 6) + b"\xff\xff" + frame
        assert len(data) > 300_000 and headers.jpeg_size(data) == (456, 123) and headers.jpeg_orientation(data) == 6
    assert headers.jpeg_size(b"\xff\xd8" + exif(1)) is None and headers.jpeg_orientation(b"\xff\xd8\xff\xe1") == 1


def test_images_are_turned_upright():
    image = picture(2)[:, :40]
    row = {"height": 48, "width": 40, "nChannels": 3, "data": image[:, :, ::-1].tobytes()}
    back = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}
    for turn, undo in back.items():
        assert (pixels.UPRIGHT[undo](pixels.from_row(row, turn)) == image).all()
    assert (pixels.from_row(row, 6)[0, -1] == image[0, 0]).all()


def test_whole_run(spark, dataset):
    config = settings(dataset)
    pipelines.run_audit(spark, config)
    manifest = pipelines.build_manifest(spark, config)
    counts = {(r["split"], r.pair_label): r["count"] for r in manifest.groupBy("split", "pair_label").count().collect()}
    assert counts == {(s, label): 4 for s in ("train", "val", "test") for label in ("stable", "changing")}
    # Every target is there, with the checksum and size that the manifest tells, and the recipe drawn.
    for r in manifest.filter("pair_label = 'stable'").collect():
        data = Path(r.target_path).read_bytes()
        assert (hashlib.sha256(data).hexdigest(), r.target_width, r.target_height) == (r.target_checksum, 32, 32)
        recipe = json.loads(r.augmentation_recipe_json)
        assert recipe["severity"] == "mild" and {"brightness", "contrast", "rotation_degrees"} <= set(recipe)
    known = pipelines.run_images(spark, config, manifest)
    ids = {x for r in manifest.collect() for x in (r.context_image_id, r.target_image_id)}
    assert {r.image_id for r in known.select("image_id").collect()} == ids
    pipelines.run_embeddings(spark, config, manifest)
    vectors = artifacts.read_vectors(spark, f"{config.run_dir}/embeddings", "color_texture")
    assert {r.image_id for r in vectors.collect()} == ids
    far = pipelines.image_distances(manifest, known, 32)
    found = {r.model: r for r in pipelines.run_baselines(spark, config, manifest, {"color_texture": vectors}, distances=far).collect()}
    assert set(found) == {"pixel", "ssim", "color_texture"} and all(0 <= r.auroc <= 1 for r in found.values())
    assert pipelines.baseline_seeds(config, ["pixel", "ssim", "a", "b"]) == {"pixel": 16, "ssim": 28, "a": 106, "b": 107}
    # Variants come out the same again, whatever the partitions.
    draft = spark.read.parquet(f"{config.run_dir}/draft").filter("pair_label = 'stable'").withColumn("target_path", F.concat(F.lit(f"{dataset}/again/"), "pair_id"))
    again = {r.pair_id: r.checksum for r in pipelines.stable_variants(draft.repartition(3), known, 32, 5).collect()}
    assert again == {r.pair_id: r.target_checksum for r in manifest.filter("pair_label = 'stable'").collect()}
    with pytest.raises(checks.InvalidData, match="another configuration"):
        pipelines.build_manifest(spark, replace(config, seed=6))
    result = pipelines.train(spark, config, manifest, vectors)
    assert 0 <= result["metrics"]["test"]["auroc"] <= 1 and not result["representation_health"]["collapsed"]
    best = max(found.values(), key=lambda r: r.auroc)
    assert result["result"]["strongest_baseline"]["auroc"] == pytest.approx(best.auroc)
    assert pipelines.benchmark(spark, config, 0.0)["passed"]
    assert json.loads((dataset / "runs" / "run1" / "config.json").read_text())["seed"] == 5
    stored = json.loads((dataset / "runs" / "run1" / "metrics.json").read_text())
    assert stored["training"]["stable_pairs_used_for_training"] == 4
    rows = artifacts.read_runs(spark, str(dataset / "runs")).collect()
    assert [r.run_id for r in rows] == ["run1"]
    assert artifacts.missing_runs(artifacts.read_runs(spark, str(dataset / "runs")), ["run0", "run1"]) == ["run0"]


def test_fixture_run(spark, tmp_path):
    config = C.Config("fix", str(tmp_path / "runs"), 1, fixture=C.Fixture(lesions_per_split=6))
    manifest = pipelines.build_manifest(spark, config)
    assert manifest.count() == 18 and pipelines.build_manifest(spark, config).count() == 18
    rows = {r.pair_id: r for r in manifest.collect()}
    assert (rows["val_stable_002"].context_image_id, rows["val_stable_002"].target_image_id) == ("val_base_002", "val_base_002_stable_002")
    assert (rows["val_changing_002"].context_image_id, rows["val_changing_002"].target_image_id) == ("val_base_005", "val_base_000")
    assert rows["test_changing_000"].pair_construction_reason == "different_synthetic_lesion_matched_within_split"
    assert all(Path(p).is_file() for r in rows.values() for p in (r.context_path, r.target_path))
    assert manifest.filter("split = 'val'").rdd.getNumPartitions() >= 1
    with pytest.raises(FileNotFoundError):
        pipelines.benchmark(spark, config)


def test_predictors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(32, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.5 * rng.normal(size=16)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    x, y = x.astype(np.float32), y.astype(np.float32)
    common = {"seed": 0, "epochs": 60, "batch": 8, "rate": 0.05, "decay": 0.0001}
    states = [predictor.fit_linear(x, y, (x, y), **common), predictor.fit_mlp(x, y, (x, y), **common, hidden=32), predictor.fit_mlp(x, y, (x, y), **common | {"rate": 0.003}, hidden=32, optimizer="adam")]
    for state in states:
        assert state["history"][-1]["train_loss"] < state["history"][0]["train_loss"]
        assert [h["epoch"] for h in state["history"]] == [1, 6, 12, 18, 24, 30, 36, 42, 48, 54, 60]
    df = spark.createDataFrame([(f"p{i:02d}", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pair_id string, x array<float>, y array<float>")
    for state in states:
        rows = predictor.score(df, state).orderBy("pair_id").collect()
        made = predictor.predict(x, state)
        made /= np.linalg.norm(made, axis=1, keepdims=True)
        assert [r.score for r in rows] == pytest.approx((1 - (made * y).sum(1)).tolist(), abs=1e-5)
    weight = predictor.ridge(df, 0.5, 16)["weight"]
    x, y = x.astype(float), y.astype(float)
    assert weight == pytest.approx(np.linalg.solve(x.T @ x + 0.5 * np.eye(16), x.T @ y + 0.5 * np.eye(16)), abs=1e-5)
    with pytest.raises(ValueError):
        predictor.fit_mlp(x, y, (x, y), **common, optimizer="other")


def test_a_missing_vector_is_an_error(spark):
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, context_image_id string, target_image_id string")
    vectors = spark.createDataFrame([("a", [1.0])], "image_id string, vector array<double>")
    with pytest.raises(KeyError, match="b"):
        predictor.pair_vectors(pairs, vectors)


def test_pixels():
    image = picture(3)
    assert pixels.resize(image, 48, 48) == pytest.approx(image)
    flat = np.full((30, 50, 3), 77, np.uint8)
    assert (pixels.resize(flat, 20, 10) == 77).all() and pixels.square(flat, 32).shape == (32, 32, 3)
    a, b = pixels.square(image, 32), pixels.square(picture(9), 32)
    assert pixels.pixel_distance(a, a) == 0 and pixels.ssim_distance(a, a) == pytest.approx(0, abs=1e-12) and 0 < pixels.ssim_distance(a, b) < 2
    vector = pixels.features(a)
    assert vector.shape == (386,) and np.linalg.norm(vector) == pytest.approx(1, abs=1e-5)
    assert pixels.features(np.full((32, 32, 3), 0.5, np.float32))[-15:] == pytest.approx(np.zeros(15))
    assert (pixels.perceptual_hash(image) ^ pixels.perceptual_hash(pixels.resize(image, 64, 64))).bit_count() <= 12
    one, recipe = pixels.mild(image, 1, np.random.default_rng(1))
    assert one.shape == image.shape and recipe["blur_radius"] == 0.18 and recipe["noise_sigma"] == 0
    two, recipe = pixels.photometric(image, 0, np.random.default_rng(1))
    assert two.shape == image.shape and not set(recipe) & {"brightness", "contrast", "rotation_degrees"}
    assert pixels.jpeg_round_trip(flat, 90) == pytest.approx(flat, abs=1)
    rough, fine = (np.abs(pixels.jpeg_round_trip(image, q).astype(int) - image).mean() for q in (20, 95))
    assert fine < rough
    kinds = {}
    for name, make in pixels.FAMILIES.items():
        made, recipe = make(image, 4, np.random.default_rng(2))
        assert made.shape == image.shape and made.dtype == np.uint8 and recipe["severity"] == name
        kinds[name] = set(recipe) - {"family", "severity", "jpeg_quality"}
    assert not kinds["strong"] & kinds["strong_held_out"] and not kinds["strong"] & kinds["strong_held_out_2"] and not kinds["strong_held_out"] & kinds["strong_held_out_2"]
    made, recipe = pixels.variant(image, 32, ["strong", "strong_held_out"], 3, np.random.default_rng(1))
    assert (made.shape, recipe["severity"], recipe["mixture"]) == ((32, 32, 3), "strong_held_out", "strong,strong_held_out")
    assert pixels.png(image) == png(image)
    assert pixels._hue_turned(image, 0) == pytest.approx(image, abs=6)
    row = {"height": 1, "width": 1, "nChannels": 3, "data": bytes([1, 2, 3])}
    assert pixels.from_row(row).tolist() == [[[3, 2, 1]]]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("run_id: r\nseed: 3\nfixture: {lesions_per_split: 6}\nembedding_models: [{model_id: m}]\n")
    config = C.load(str(path), run_id="other")
    assert (config.run_id, config.seed, config.tier, config.embedding_models[0].kind) == ("other", 3, "fixture", "color_texture")
    bad = ["run_id: r\n", "run_id: r\nfixture: {lesions_per_split: 2}\n", "run_id: r\nfixture: {}\nseed: x\n", "run_id: r\nfixture: {}\nnope: 1\n", "- 1\n", "run_id: r\nfixture: {}\ntraining: {optimizer: lbfgs}\n"]
    for text in bad:
        path.write_text(text)
        with pytest.raises(C.ConfigError):
            C.load(str(path))
    for more in ({"split": C.Fractions}, {"nuisance_severity": "wild"}, {"changing_pair_policy": "any"}, {"image_roots": ()}):
        with pytest.raises((C.ConfigError, TypeError)):
            C.Dataset(**({"name": "a", "metadata_csv": "b", "image_roots": ("c",)} | ({"split": C.Fractions(0.5, 0.5, 0.5)} if "split" in more else more)))


def test_artifacts(spark, tmp_path):
    np.savez(tmp_path / "v.npz", image_ids=np.array(["a", "b"]), embeddings=np.eye(2))
    assert {r.image_id: r.vector for r in artifacts.import_npz(spark, str(tmp_path / "v.npz")).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    np.savez(tmp_path / "w.npz", image_ids=np.array(["a"]), embeddings=np.eye(2))
    with pytest.raises(ValueError):
        artifacts.import_npz(spark, str(tmp_path / "w.npz"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.PNG", png(picture(1)))
        z.writestr("notes.txt", "x")
        z.writestr("d/b.png", b"no image")
    members = images.archive_members(spark, str(tmp_path / "z.zip"))
    assert sorted(r.member for r in members.collect()) == ["d/a.PNG", "d/b.png"]
    files = images.extract(members, str(tmp_path / "out"))
    assert {r.member: Path(r.path).read_bytes() for r in files.collect()} == {"d/a.PNG": png(picture(1)), "d/b.png": b"no image"}
    named = files.select(F.concat_ws("/", "archive", "member").alias("image_id"), "archive", "position", "member", "path")
    hashes = images.perceptual_hashes(images.pictures(named, images.images_in(spark, [str(tmp_path / "out")])))
    assert [r.hash for r in hashes.collect()] == [pixels.perceptual_hash(picture(1))]
    done = named.join(hashes.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    assert [(r.members, r.hashed) for r in images.coverage(members, done).collect()] == [(2, 1)]
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        artifacts.read_document(spark, str(tmp_path / "list.json"))


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "m.csv").write_text('image_id,dx,site\na,"two\nlines",arm\nb,"say ""x""",leg\nc,,\n')
    rows = metadata.read_csv(spark, str(tmp_path / "m.csv"), 2).collect()
    assert [tuple(r) for r in rows] == [("a", "two\nlines", "arm"), ("b", 'say "x"', "leg")]


def test_commands(spark, tmp_path, capsys):
    from pairforge.__main__ import main

    (tmp_path / "c.yaml").write_text(f"run_id: r\noutput_root: {tmp_path}/runs\nseed: 4\nfixture: {{stable_pairs_per_split: 4, changing_pairs_per_split: 4}}\nmetrics: {{bootstrap_samples: 20}}\npreprocessing: {{image_size: 32}}\ntraining: {{predictor: ridge}}\n")
    config = str(tmp_path / "c.yaml")
    assert main(["all", config, "--out", str(tmp_path / "demo")]) == 0
    shown = json.loads((tmp_path / "demo" / "demo.json").read_text())
    assert len(shown["pairs"]) == 4 and all((tmp_path / "demo" / p[f"{side}_image"]).stat().st_size for p in shown["pairs"] for side in ("context", "target"))
    assert {r["model"] for r in shown["scores"]} == {"pixel", "ssim", "color_texture"} and len(shown["failure_cases"]) == 6
    assert main(["train", config]) == 0
    capsys.readouterr()
    assert main(["summary", str(tmp_path / "runs")]) == 0
    line = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert line["run_id"] == "r" and line["stable_pairs"] == 4
    (tmp_path / "e.csv").write_text(f"run_id,value\nr,{line['primary_score']}\nother,0.5\n")
    assert main(["claims", str(tmp_path / "runs"), str(tmp_path / "e.csv")]) == 0
    (tmp_path / "e.csv").write_text(f"run_id,value\nr,{line['primary_score'] + 0.1}\n")
    assert main(["claims", str(tmp_path / "runs"), str(tmp_path / "e.csv")]) == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("copy.png", (tmp_path / "runs" / "r" / "fixture_images" / "val_base_001.png").read_bytes())
    assert main(["duplicates", config, str(tmp_path / "z.zip"), "--most", "0"]) == 0
    text = (tmp_path / "runs" / "r" / "near_duplicates.coverage.txt").read_text()
    assert "1 of 1 images hashed" in text
    with pytest.raises(ValueError, match="no embedder"):
        pipelines.run_embeddings(spark, C.load(config, run_id="s", embedding_models=[{"model_id": "m", "kind": "clip", "model_name": "x"}]), pipelines.build_manifest(spark, C.load(config, run_id="s")))


def test_events_and_streams(spark, tmp_path, capsys):
    with events.stage("s", tmp_path, x=tmp_path):
        assert list(events.progress(range(5), "p", 5, every=2, run_dir=tmp_path)) == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError), events.stage("t", tmp_path):
        raise RuntimeError("e" * 900)
    lines = [json.loads(x) for x in (tmp_path / "events.jsonl").read_text().splitlines()]
    assert [x["event"] for x in lines] == ["s.start", "p.progress", "p.progress", "p.done", "s.end", "t.start", "t.error"]
    assert len(lines[-1]["message"]) == 400
    events.log_event("kept", tmp_path / "absent")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.json").write_text((tmp_path / "events.jsonl").read_text())
    q = progress.rates(progress.events(spark, str(tmp_path / "logs"))).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event: r.n for r in spark.table("rates").collect()}["p.progress"] == 2


def test_writers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    writers.write_demo(tmp_path / "demo", "r<1>", [{"pair_id": "p", "pair_label": "stable", "context_path": str(tmp_path / "a.png"), "target_path": str(tmp_path / "gone.png")}], [])
    assert (tmp_path / "demo" / "images" / "0-context.png").read_bytes() == b"x"
    assert "r&lt;1&gt;" in (tmp_path / "demo" / "index.html").read_text()
    assert writers.bar_chart([("a", 2.0), ("b", 1.0)]).count("<rect") == 2
    assert "## Boundary" in writers.model_card("t", {"a": 1}, "b")
    with writers.run_lock(tmp_path / "held"):
        with pytest.raises(RuntimeError, match="held"), writers.run_lock(tmp_path / "held"):
            pass
    with writers.run_lock(tmp_path / "held"):
        pass
