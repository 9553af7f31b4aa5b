"""Chosen files, whole images, corpus audits and documents of any shape."""

import json
import struct
import zlib

import numpy as np
import pytest

from pairforge import __main__ as command
from pairforge.functions import pixels
from pairforge.functions.whole import intact
from pairforge.operators import corpus_audit as C
from pairforge.operators import runs
from pairforge.sources import metadata
from pairforge.sources.chosen import read_chosen

GIF = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xfe\x03abc\x00" + b"\x2c" + bytes(8) + b"\x00" + b"\x02\x02\x4c\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xc0" + struct.pack(">HBHHB", 11, 8, 2, 3, 1) + b"\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\xff\x00\x34\xff\xd0\x56\xff\xff\xc4\x00\x03\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x99" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<III", 60, 0, 54) + bytes(46)


def png():
    return pixels.png(np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3))


@pytest.mark.parametrize("make", [png, lambda: GIF, lambda: JPEG, lambda: BMP])
def test_every_cut_is_noticed(make):
    data = make()
    assert intact(data)
    assert not any(intact(data[:n]) for n in range(len(data)))


def test_broken_bodies_are_noticed():
    good = png()
    for at in range(8, len(good)):
        assert not intact(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]), at
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0))
    rows = lambda n: good[:8] + head + chunk(b"IDAT", zlib.compress(bytes(5 * n))) + chunk(b"IEND", b"")
    assert intact(rows(4)) and not intact(rows(3)) and not intact(rows(5))
    assert not intact(None) and not intact(b"") and not intact(b"text")


def test_only_chosen_files_are_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png())
    (tmp_path / "a" / "y.png").write_bytes(png()[:-9])
    with open(tmp_path / "a" / "huge.png", "wb") as f:  # no scan could hold this one
        f.truncate(3 << 30)
    paths = [f"file://{tmp_path}/a/x.png", f"{tmp_path}/a/y.png", f"{tmp_path}/a/gone.png"]
    got = {r.path: r for r in read_chosen(spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string")).collect()}
    assert [(len(got[p].content or b""), got[p].whole) for p in paths] == [(len(png()), True), (len(png()) - 9, False), (0, False)] and len(got) == 3
    (tmp_path / "m.csv").write_text("image_id,dx\nx,a\ny,b\nz,c\n")
    rows = {r.image_id: r for r in metadata.load_records(spark, str(tmp_path / "m.csv"), [str(tmp_path / "a")], ["png"], "s").collect()}
    assert [(rows[i].image_found, rows[i].width, rows[i].path != "") for i in "xyz"] == [(True, 7, True), (False, 0, True), (False, 0, False)]


IMAGE = "image_id string, source_dataset string, source_record_id string, source_uri string, license string, local_path string, sha256_raw string, sha256_canonical string, phash long, modality string, diagnosis_label string, patient_id string, lesion_id string"
KNOWN = "image_id string, lesion_id string, sha256_raw string, sha256_canonical string, phash long"


def image(name, **own):
    base = {"image_id": name, "source_dataset": "s", "source_record_id": f"r-{name}", "source_uri": None, "license": "CC0", "local_path": None, "sha256_raw": f"raw-{name}", "sha256_canonical": f"can-{name}", "phash": 0x0FFFFFFFFFFFFF00, "modality": "unknown", "diagnosis_label": None, "patient_id": None, "lesion_id": None}
    return tuple((base | own).values())


def corpus(spark):
    images = [
        image("ok"), image("named", source_record_id="k1"), image("lesion", lesion_id="l1"), image("bytes", sha256_canonical="raw-k1"), image("near", phash=0b1111), image("far", phash=(1 << 11) - 1),
        image("doubt", phash=0b111111), image("seen", phash=0b1111111), image("bare", license=" "), image("lost", source_dataset=None), image("blind", phash=None), image("first", license=None, phash=1),
    ]
    return spark.createDataFrame(images, IMAGE), spark.createDataFrame([("k1", "l1", "raw-k1", None, 0), ("k2", None, None, None, None)], KNOWN)


def test_gates(spark):
    images, known = corpus(spark)
    rows = {r.image_id: r for r in C.manifest(images, known, cleared=spark.createDataFrame([("seen",), ("near",)], "image_id string")).collect()}
    assert {k: (r.ham10000_exclusion_reason, r.manual_review_status, r.proof) for k, r in rows.items()} == {
        "ok": (None, "not_needed", None), "named": ("source_metadata", "excluded", "k1"), "lesion": ("source_metadata", "excluded", "k1"), "bytes": ("exact_hash", "excluded", "k1"),
        "near": ("perceptual_hash", "excluded", "k1:4"), "far": (None, "not_needed", None), "doubt": ("ambiguous_near_duplicate", "pending", "k1:6"), "seen": (None, "cleared", "k1:7"),
        "bare": ("missing_provenance", "excluded", None), "lost": ("missing_provenance", "excluded", None), "blind": ("not_hashed", "excluded", None), "first": ("perceptual_hash", "excluded", "k1:1"),
    }
    assert {r.split for r in rows.values() if r.ham10000_exclusion_reason is None} <= {"pretrain_train", "pretrain_val"} and rows["doubt"].split == "audit_only"
    assert list(rows["ok"].asDict()) == [*C.COLUMNS, "proof"] and len(C.COLUMNS) == 16


def test_an_audit_with_a_broken_gate_fails(spark, tmp_path):
    images, known = corpus(spark)
    audited = C.manifest(images, known)
    assert C.violations(audited, known).count() == 0
    assert {(r.gate, r.image_id) for r in C.violations(audited.withColumn("split", F_lit("pretrain_train")), known).collect()} >= {("exact_hash", "bytes"), ("perceptual_hash", "near"), ("ambiguous_near_duplicate", "doubt"), ("missing_provenance", "bare")}
    images.write.parquet(str(tmp_path / "i"))
    known.write.parquet(str(tmp_path / "k"))
    assert command.main(["corpus", str(tmp_path / "i"), str(tmp_path / "k"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "manifest")).count() == 12


def F_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_documents_of_any_shape(spark):
    docs = [
        {"run_id": "a", "primary_score": 1, "representation_health": {"collapsed": True}, "training": {"stable_pairs_used_for_training": 7}, "result": {"strongest_baseline": {"name": "p", "auroc": 0.5}}},
        {"run_id": "b", "primary_score": True, "representation_health": {"collapsed": 1}, "training": {"stable_pairs_used_for_training": "7"}, "result": []},
        {"run_id": 3, "primary_score": "0.5", "representation_health": "no", "result": {"strongest_baseline": "p"}}, [1], "text",
    ]
    texts = [json.dumps(d) for d in docs] + ["{broken", None]
    got = runs.summarise(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert (got[0].primary_score, got[0].collapsed, got[0].stable_pairs, got[0].baseline_name, got[0].baseline_auroc) == (1.0, True, 7, "p", 0.5)
    assert [(r.primary_score, r.collapsed, r.stable_pairs, r.baseline_name) for r in got[1:]] == [(None,) * 4] * 6
    assert [r.run_id for r in got] == ["a", "b"] + [None] * 5
