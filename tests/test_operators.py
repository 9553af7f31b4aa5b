"""Operators against brute force and hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import text as names
from pairforge.functions.order import hash_order, running_sums
from pairforge.functions.vectors import cosine_distance, hamming, normalised
from pairforge.operators import audit, checks, metrics, neardup, pairs, ranking, runs, split
from pairforge.schema import MATCHES, RECORDS


def scores(spark, rows):
    return spark.createDataFrame(rows, "label_int int, score double, pair_id string")


def brute_auroc(rows):
    pos, neg = [s for y, s, *_ in rows if y], [s for y, s, *_ in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_curve(rows):
    points = []
    for t in sorted({s for _, s, *_ in rows}, reverse=True):
        points.append((t, sum(y for y, s, *_ in rows if s >= t), sum(1 - y for y, s, *_ in rows if s >= t)))
    kept = [p for i, p in enumerate(points) if i in (0, len(points) - 1) or any(points[i - 1][k] - 2 * p[k] + points[i + 1][k] for k in (1, 2))]
    return [(float("inf"), 0, 0), *kept]


@pytest.mark.parametrize("levels", [2, 7, 1000])
def test_metrics_with_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(int(rng.random() < 0.4), float(rng.randint(0, levels)), f"p{i:03d}") for i in range(120)]
    df = scores(spark, rows)
    assert metrics.auroc(df).first()[0] == pytest.approx(brute_auroc(rows))
    curve = [(r.threshold, r.tp, r.fp) for r in metrics.roc_points(df).orderBy("idx").collect()]
    assert curve == brute_curve(rows)
    p, n = curve[-1][1:]
    gaps = [(abs(fp / n - (1 - tp / p)), i) for i, (_, tp, fp) in enumerate(curve)]
    _, best = min(gaps)
    eer = metrics.equal_error(metrics.roc_points(df)).first()
    assert eer.eer_threshold == curve[best][0]
    assert eer.equal_error_rate == pytest.approx((curve[best][2] / n + 1 - curve[best][1] / p) / 2)
    full = [(t, sum(y for y, s, *_ in rows if s >= t), sum(1 for _, s, *_ in rows if s >= t)) for t in sorted({r[1] for r in rows}, reverse=True)]
    ap, before = 0.0, 0
    for _, tp, seen in full:
        ap, before = ap + (tp - before) / p * tp / seen, tp
    assert metrics.auprc(df).first()[0] == pytest.approx(ap)
    assert metrics.fpr_at_tpr(metrics.roc_points(df), 0.8).first()[0] == pytest.approx(min(fp / n for _, tp, fp in curve if tp / p >= 0.8))


def test_perfect_separation(spark):
    df = scores(spark, [(0, 0.05, "a"), (0, 0.10, "b"), (1, 0.90, "c"), (1, 0.95, "d")])
    row = metrics.metric_summary(df).first()
    assert (row.auroc, row.auprc, row.fpr_at_fixed_tpr, row.equal_error_rate) == (1, 1, 0, 0)
    ends = metrics.bootstrap_sequential(df.withColumn("g", F.lit("x")), ["g"], "pair_id", 50, 0.95, 1).first()
    assert (ends.auroc_ci_low, ends.auroc_ci_high) == (1, 1)
    ends = metrics.bootstrap_native(df, "pair_id", 50, 0.95, 1).first()
    assert (ends.auroc_ci_low, ends.auroc_ci_high) == (1, 1)


def test_collinear_points_are_left_out(spark):
    rows = [(1, 5.0, "a"), (1, 4.0, "b"), (1, 3.0, "c"), (0, 2.0, "d"), (0, 1.0, "e")]
    curve = [(r.threshold, r.tp, r.fp) for r in metrics.roc_points(scores(spark, rows)).orderBy("idx").collect()]
    assert curve == [(float("inf"), 0, 0), (5.0, 1, 0), (3.0, 3, 0), (1.0, 3, 2)]


def test_invalid_groups(spark):
    rows = [("a", 1, 1.0), ("a", 0, 2.0), ("b", 1, 1.0), ("c", 2, 1.0), ("c", 0, 1.0), ("c", 1, 1.0), ("d", 0, None), ("d", 1, 1.0), ("d", 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, label_int int, score double")
    assert {r.g for r in metrics.invalid_groups(df, ["g"]).collect()} == {"b", "c", "d"}


def test_sequential_bootstrap_is_numpys_stream(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.5), rng.random(), f"p{i:02d}") for i in range(40)]
    got = metrics.bootstrap_sequential(scores(spark, rows).withColumn("g", F.lit("x")), ["g"], "pair_id", 200, 0.9, 7).first()
    gen, values = np.random.default_rng(7), []
    for _ in range(200):
        drawn = [rows[i] for i in gen.choice(np.arange(40), size=40, replace=True)]
        if 0 < sum(r[0] for r in drawn) < 40:
            values.append(brute_auroc(drawn))
    assert (got.auroc_ci_low, got.auroc_ci_high) == pytest.approx(tuple(np.quantile(values, [0.05, 0.95])))


def test_running_sums_and_hash_order(spark):
    rng = random.Random(5)
    rows = [(g, float(s), rng.randint(0, 9)) for g in ("a", None) for s in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g string, s double, v long")
    for down in (False, True):
        for r in running_sums(df, ["g"], "s", ["v"], down).collect():
            assert r.v_upto == sum(v for g, s, v in rows if g == r.g and (s >= r.s if down else s <= r.s))
    ranked = hash_order(spark.range(500).select(F.col("id").cast("string").alias("k")), 9, "k").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(500))


def test_strongest_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("pixel", 0.7, 0), ("ssim", 0.9, 1), ("vectors", 0.9, 2)], "model string, auroc double, ordinal int")
    assert metrics.strongest(df).first().model == "ssim"


def records(spark, n, seed, patients=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lesion = f"L{rng.randint(0, n // 2):03d}"
        has = patients and int(lesion[1:]) % 3 == 0
        rows.append((f"I{i:03d}", lesion, True, f"P{int(lesion[1:]) // 9}" if has else f"missing_patient::{lesion}", has, rng.choice("abc"), rng.choice("xyz"), "d", f"/{i}", True, "c", 1, 1))
    return spark.createDataFrame(rows, RECORDS), rows


def order(r):
    return r[5], r[6], r[1], r[0]


def brute_match(context, rows, k, strict):
    other = [r for r in rows if r[1] != context[1]]
    stages = [
        [r for r in other if context[4] and r[4] and r[3] == context[3]],
        [r for r in other if r[5:7] == context[5:7]],
        [r for r in other if r[5] == context[5]],
        [r for r in other if r[6] == context[6]],
        other,
    ]
    for reason, found in [(MATCHES[1], stages[1])] if strict else zip(MATCHES, stages, strict=True):
        if found:
            return sorted(found, key=order)[k % len(found)][0], reason
    return None


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_changing_pairs_equal_the_nested_loop(spark, seed, strict):
    df, rows = records(spark, 40, seed)
    assigned = df.withColumn("split", F.when(F.crc32("lesion_id") % 2 == 0, "train").otherwise("test"))
    placed = pairs.positions(assigned)
    got = {}
    for r in pairs.changing_pairs(placed, 3, 30, strict).collect():
        got[r.split, r.ordinal] = (r.image_id, r.target.image_id, r.reason)
    side = {r.image_id: r.split for r in assigned.collect()}
    want = {}
    for s in ("train", "test"):
        own = sorted([r for r in rows if side[r[0]] == s], key=order)
        taken = 0
        for k in range(4 * len(own)):
            context = own[(k + 3) % len(own)]
            if taken < 30 and (match := brute_match(context, own, k, strict)):
                want[s, taken] = (context[0], *match)
                taken += 1
    assert got == want


def test_stable_anchors_are_the_first(spark):
    df, rows = records(spark, 30, 4)
    placed = pairs.positions(df.withColumn("split", F.lit("train")))
    got = [r.image_id for r in pairs.stable_anchors(placed, 6).orderBy("k").collect()]
    assert got == [r[0] for r in sorted(rows, key=order)[:6]]


def test_split_sizes():
    assert split.split_sizes(7470, 0.7, 0.15) == (5229, 1120, 1121)
    assert split.split_sizes(3, 0.7, 0.15) == (1, 1, 1)
    assert split.split_sizes(5, 0.5, 0.5) == (2, 2, 1)
    with pytest.raises(ValueError):
        split.split_sizes(2, 0.7, 0.15)


def test_groups_stay_together_and_reruns_agree(spark):
    df, _ = records(spark, 90, 6)
    rows = split.split_records(df, 3)
    assert rows.groupBy("split_group").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert rows.select("split").distinct().count() == 3
    again = split.split_records(df.repartition(5), 3)
    assert sorted(rows.select("image_id", "split").collect()) == sorted(again.select("image_id", "split").collect())
    seq = split.split_records(df, 3, sequential=True).select("split_group", "split").distinct().collect()
    keys = sorted({r.split_group for r in seq})
    shuffled = [keys[i] for i in np.random.default_rng(3).permutation(len(keys))]
    n, v, _ = split.split_sizes(len(keys), 0.7, 0.15)
    assert {r.split_group: r.split for r in seq} == {k: "train" if i < n else "val" if i < n + v else "test" for i, k in enumerate(shuffled)}


def test_manifest_violations_name_every_rule(spark):
    good = {"pair_id": "p", "split": "train", "pair_label": "stable", "context_lesion_id": "a", "target_lesion_id": "a", "context_patient_id": "x", "target_patient_id": "x", "preprocessing_profile": "sq"}
    rows = [
        good, good | {"pair_id": "q", "pair_label": "changing", "target_lesion_id": "b", "target_patient_id": "y"},
        good | {"pair_id": "q", "split": "val", "context_lesion_id": "c", "target_lesion_id": "d"}, good | {"pair_id": "r", "split": "dev"},
        good | {"pair_id": "s", "pair_label": "odd", "preprocessing_profile": ""}, good | {"pair_id": "t", "pair_label": "changing"},
    ]
    cols = ", ".join(f"{k} string" for k in good)
    found = checks.manifest_violations(spark.createDataFrame([tuple(r.values()) for r in rows], cols))
    rules = {r.rule for r in found.collect()}
    assert rules == {"unique pair_id", "known split", "known label", "preprocessing profile", "stable pairs keep the lesion", "changing pairs change the lesion", "patient in one split", "both labels in each split"}
    with pytest.raises(checks.InvalidData, match="unique pair_id"):
        checks.validate(found)
    assert "manifest not empty" in {r.rule for r in checks.manifest_violations(spark.createDataFrame([], cols)).collect()}


def test_hamming_join_finds_all(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 14))) for b in base for _ in range(4)] + [0, 2**64 - 1, base[0]]
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    left, right = spark.createDataFrame(signed[:60], "id long, hash long"), spark.createDataFrame([*signed[60:], (999, None)], "id long, hash long")
    got = {(r.a_id, r.b_id): r.distance for r in neardup.hamming_join(left, right).collect()}
    want = {(a, b): d for a, b in itertools.product(range(60), range(60, len(values))) if (d := (values[a] ^ values[b]).bit_count()) <= 10}
    assert got == want
    bands = {r.distance: r.n for r in neardup.distance_bands(neardup.hamming_join(left, right)).collect()}
    assert bands == {b: sum(d <= b for d in want.values()) for b in (0, 2, 4, 6, 8, 10)}
    assert spark.range(1).select(hamming(F.lit(-1), F.lit(0))).first()[0] == 64


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(normalised(F.col("a")).alias("a"), *[normalised(F.col("z"), rule).alias(rule) for rule in ("keep", "epsilon", "one")], cosine_distance(F.array(F.lit(2.0)), F.array(F.lit(1.0))).alias("far")).first()
    assert row.a == pytest.approx([0.6, 0.8]) and row["keep"] == row.epsilon == row.one == [0, 0] and row.far == 0
    with pytest.raises(ValueError):
        normalised(F.col("a"), "other")


def test_collapse(spark):
    flat = spark.createDataFrame([([1.0, 0.0],)] * 3, "prediction array<double>")
    assert metrics.collapse_checks(flat).first().collapsed
    spread = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "prediction array<double>")
    row = metrics.collapse_checks(spread).first()
    assert not row.collapsed and row.dimension_variance_mean == pytest.approx(0.25)


def test_failures_break_ties_by_place(spark):
    rows = [("m", f"p{i}", label, s, i) for i, (label, s) in enumerate([("stable", 0.9), ("stable", 0.9), ("stable", 0.1), ("stable", 0.5), ("changing", 0.2), ("changing", 0.2), ("changing", 0.8)])]
    df = spark.createDataFrame(rows, "model string, pair_id string, pair_label string, score double, ordinal int")
    got = {}
    for r in ranking.failures(df, "model").orderBy("place").collect():
        got.setdefault(r.failure_mode, []).append(r.pair_id)
    assert got == {"stable_high_score": ["p1", "p0", "p3"], "changing_low_score": ["p4", "p5", "p6"]}


def test_runs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in runs.sweep(df, "g", "v").collect()}
    assert (got["b"].n, got["b"]["std"], got["b"].ci_low) == (1, 0.0, 5.0)
    assert got["a"].ci_high == pytest.approx(2 + 1.96 * 2**0.5 / 2**0.5)
    docs = spark.createDataFrame([('{"run_id":"r1","primary_score":"not trained","result":{"strongest_baseline":{"name":"ssim","auroc":0.5}},"representation_health":{"collapsed":false}}',), ("{}",)], "json string")
    rows = runs.summarise(docs).collect()
    assert (rows[0].primary_score, rows[0].baseline_auroc, rows[0].collapsed, rows[1].run_id) == (None, 0.5, False, None)
    claims = runs.check_claims(spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "run_id string, value double"), spark.createDataFrame([("a", 0.5004), ("b", 0.6)], "run_id string, value double"))
    assert {r.run_id: r.status for r in claims.collect()} == {"a": "PASS", "b": "FAIL", "c": "SKIP"}
    gate = runs.accepted(spark.createDataFrame([(0.5,), (0.96,)], "auroc double")).first()
    assert gate.passed and not runs.accepted(spark.createDataFrame([(0.5,)], "auroc double")).first().passed
    stated = spark.range(1).select(runs.stated(F.lit("fell by 41.8 %"), F.lit(42.0)).alias("a"), runs.stated(F.lit("none"), F.lit(1.0)).alias("b"), runs.loss_reduction(F.lit(4.0), F.lit(1.0)).alias("c")).first()
    assert tuple(stated) == (True, False, 75.0)


def test_text_functions(spark):
    row = spark.range(1).select(
        names.families(F.lit(" a, ,b")).alias("f"), names.safe_name(F.lit("é/x y-1_")).alias("s"), names.stem(F.lit("/a/b.c.png")).alias("t"),
        names.short_number(F.lit(2.5)).alias("n"), names.short_number(F.lit(3.0)).alias("m"), names.first_filled([F.lit(" "), F.lit(None).cast("string"), F.lit(" v ")]).alias("v"),
        names.outcome(F.lit(0.05), F.lit(False)).alias("o"), names.stable_reason(names.families(F.lit("strong, mild"))).alias("r"),
    ).first()
    assert tuple(row) == (["a", "b"], "é_x_y-1_", "b.c", "2.5", "3", "v", "clear_improvement", "same_image_post_split_mixed_nuisance")


def test_audit_counts(spark):
    df, rows = records(spark, 12, 3)
    df = df.withColumn("image_found", F.col("image_id") != "I003").withColumn("path", F.when(F.col("image_id") == "I003", "").otherwise(F.col("path")))
    found = audit.audit(df)
    assert found["image_availability"] == {"found": 11, "missing": 1, "unreadable": 0, "missing_sample": ["I003"], "unreadable_sample": []}
    assert sum(found["diagnosis_counts"].values()) == 12 and found["duplicate_probes"]["duplicate_checksum_count"] == 1
    assert "do not have local images" in found["leakage_risk_note"]


def test_skewed_scores_fill_ranges_alike(spark):
    from pairforge.functions.order import in_ranges, running_sums

    df = spark.range(20_000).selectExpr("exp(id / 1000.0) + id / 1e6 as score", "1 as one", "'a' as g").unionByName(spark.range(50).selectExpr("double(id) as score", "1 as one", "'b' as g"))
    sizes = in_ranges(df.filter("g = 'a'"), ["g"], "score").groupBy("_bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 0.02 * 20_000
    rows = running_sums(df, ["g"], "score", ["one"], descending=True, following=["one"]).groupBy("g").agg(F.max("one_upto").alias("n"), F.count_if(F.col("one_next").isNull()).alias("last")).collect()
    assert {(r.g, r.n, r.last) for r in rows} == {("a", 20_000, 1), ("b", 50, 1)}


def test_few_chance_meetings_of_random_hashes(spark):
    a = spark.range(2000).select(F.xxhash64("id").alias("ha"))
    b = spark.range(50_000).select(F.xxhash64(F.col("id") + 10**6).alias("hb"))
    assert neardup.hamming_candidates(a, b, 10).count() < 0.01 * 2000 * 50_000
