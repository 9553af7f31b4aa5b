"""Near duplicates as classes, by several hashes and against a stream; with adaptive plans, as a cluster runs them."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from pairforge.functions import pixels
from pairforge.operators import neardup
from pairforge.streaming import near


@pytest.fixture(autouse=True)
def adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "false")


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def near_values(rng, n, most=14):
    base = [rng.getrandbits(64) for _ in range(n)]
    return [signed(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, most)))) for b in base for _ in range(3)]


def far(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_copies_are_classes(spark):
    same = spark.range(2000).selectExpr("id", "42L as hash")
    others = spark.range(5000, 7000).selectExpr("id", "43L as hash")
    got = neardup.hamming_classes(same, others).collect()
    assert [(r.a_id, r.b_id, r.distance, r.n_a, r.n_b) for r in got] == [(0, 5000, 1, 2000, 2000)]
    assert neardup.class_members(same, others).count() == 4000
    assert {r.distance: r.n for r in neardup.distance_bands(neardup.hamming_classes(same, others)).collect()} == {0: 0, **dict.fromkeys((2, 4, 6, 8, 10), 4_000_000)}


def test_pairs_rebuilt_from_classes_are_all_pairs(spark):
    rng = random.Random(3)
    values = near_values(rng, 25) * 2
    rows = [(i, v) for i, v in enumerate(values)] + [(900, None)]
    left, right = spark.createDataFrame(rows[::2], "id long, hash long"), spark.createDataFrame(rows[1::2], "id long, hash long")
    members = {}
    for r in neardup.class_members(left, right).collect():
        members.setdefault((r.side, r.hash), []).append(r.id)
    rebuilt = Counter()
    for r in neardup.hamming_classes(left, right).collect():
        a, b = members["a", r.ha], members["b", r.hb]
        assert (r.a_id, r.b_id, r.n_a, r.n_b) == (min(a), min(b), len(a), len(b))
        rebuilt.update((x, y, r.distance) for x in a for y in b)
    want = {(a, b, d) for (a, x), (b, y) in itertools.product(rows[::2], rows[1::2]) if x is not None and y is not None and (d := far(x, y)) <= 10}
    assert set(rebuilt) == want and set(rebuilt.values()) == {1}
    assert {(r.a_id, r.b_id, r.distance) for r in neardup.hamming_join(left, right).collect()} == want


def assert_bands_are_merged(found):
    """The join by bands, as it was run, shuffled both sides."""
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    met = [line for line in plan.splitlines() if "Join" in line and "[band#" in line]
    assert len(met) == 1 and "SortMergeJoin" in met[0], met


@pytest.mark.parametrize("few", ["a", "b"])
def test_near_values_are_not_broadcast(spark, few):
    # Spark knows the few hashes' size when it plans this join, and not how many near values each has.
    rng = random.Random(6)
    values = near_values(rng, 60)
    rows = [list(enumerate(values[:9])), list(enumerate(values))][:: 1 if few == "a" else -1]
    found = neardup.hamming_classes(*(spark.createDataFrame(r, "id long, hash long") for r in rows))
    assert {(r.a_id, r.b_id, r.distance) for r in found.collect()} == {(x, y, far(v, w)) for (x, v), (y, w) in itertools.product(*rows) if far(v, w) <= 10}
    assert_bands_are_merged(found)


@pytest.mark.parametrize("few", ["a", "b"])
def test_pairs_of_rows_are_found_without_broadcasting_near_values(spark, few):
    rng = random.Random(7)
    values = near_values(rng, 60) * 2
    rows = [list(enumerate(values[:12])), list(enumerate(values))][:: 1 if few == "a" else -1]
    found = neardup.hamming_join(*(spark.createDataFrame(r, "id long, hash long") for r in rows))
    assert Counter(map(tuple, found.collect())) == Counter((x, y, far(v, w)) for (x, v), (y, w) in itertools.product(*rows) if far(v, w) <= 10)
    assert_bands_are_merged(found)


def test_near_values_are_made_by_as_many_tasks_as_hashes_want(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HASHES_A_TASK", 3)
    hashes = [(signed(random.Random(i).getrandbits(64)),) for i in range(10)]
    found = neardup.near_hashes(spark.createDataFrame(hashes, "ha long"), spark.createDataFrame(hashes, "hb long"), 10)
    assert sorted(r.ha for r in found.collect()) == sorted(h for h, in hashes)
    assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(ha" in plan and ", 4), REPARTITION_BY_NUM" in plan


def test_a_stream_is_held_against_an_index_that_is_written_once(spark, tmp_path):
    rng = random.Random(4)
    values = near_values(rng, 30)
    rows = list(enumerate(values))
    neardup.write_index(spark.createDataFrame(rows[::2], "id long, hash long"), "near_index", str(tmp_path / "index"), buckets=2)
    plan = neardup.near_in_index(spark.createDataFrame(rows[:3], "id long, hash long"), spark.table("near_index").hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    (tmp_path / "in").mkdir()
    hashes = spark.readStream.schema("id long, hash long").parquet(str(tmp_path / "in"))
    for part in (rows[1:40:2], rows[41::2]):
        spark.createDataFrame(part, "id long, hash long").write.mode("append").parquet(str(tmp_path / "in"))
        near.watch(spark, hashes, "near_index", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = Counter((r.a_id, r.id, r.distance) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = {(a, b, d) for (a, x), (b, y) in itertools.product(rows[::2], rows[1::2]) if (d := far(x, y)) <= 10}
    assert {(min(i for i, v in rows[::2] if v == dict(rows)[a]), b, d) for a, b, d in want} == set(got) and set(got.values()) == {1}
    spark.sql("drop table near_index")


def test_agreement_of_four_hashes_is_brute_force(spark):
    rng = random.Random(5)
    names = list(pixels.HASHES)
    rows = []
    for i in range(40):
        base = [rng.getrandbits(64) for _ in names]
        for k in range(3):
            rows.append((i * 3 + k, *(signed(b ^ sum(1 << j for j in rng.sample(range(64), rng.choice([0, 2, 5, 6, 7, 20])))) for b in base)))
    rows += [(500 + r[0], *r[1:]) for r in rows[:9]] + [(999, None, 1, 2, 3)]
    schema = "id long, " + ", ".join(f"{n} long" for n in names)
    left, right = rows[::2], rows[1::2]
    whole = lambda rs: {h: sorted(r[0] for r in rs if r[1:] == h) for h in {r[1:] for r in rs if None not in r}}
    want = {(x[0], y[0], v, len(x), len(y)) for (h, x), (g, y) in itertools.product(whole(left).items(), whole(right).items()) if (v := sum(far(a, b) <= 6 for a, b in zip(h, g, strict=True))) >= 3}
    got = neardup.agreeing_classes(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), names)
    assert {tuple(r) for r in got.collect()} == want and want


def test_hashes_bear_noise_and_tell_pictures_apart():
    rng = np.random.default_rng(2)
    smooth = lambda: pixels.resize(rng.integers(0, 256, (6, 6, 3)).astype(np.uint8), 90, 70)
    pictures = [smooth() for _ in range(6)]
    for name, make in pixels.HASHES.items():
        for p in pictures:
            noisy = np.clip(p.astype(int) + rng.integers(-3, 4, p.shape), 0, 255).astype(np.uint8)
            assert far(make(p), make(noisy)) <= 6, name
            assert far(make(p), make(pixels.resize(p, 180, 140))) <= 6, name
        assert min(far(make(p), make(q)) for p, q in itertools.combinations(pictures, 2)) > 10, name


def test_hashes_of_plain_pictures_by_definition():
    step = np.zeros((64, 64, 3), np.uint8)
    step[:, 32:] = 255
    assert pixels.average_hash(step) & (2**64 - 1) == int("00001111" * 8, 2)
    assert pixels.wavelet_hash(step) & (2**64 - 1) == int("00001111" * 8, 2)
    rising = np.repeat(np.arange(0, 252, 4, dtype=np.uint8)[None, :, None], 63, axis=0).repeat(3, axis=2)
    assert pixels.difference_hash(rising) & (2**64 - 1) == 2**64 - 1
