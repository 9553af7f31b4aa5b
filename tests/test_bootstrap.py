"""Replicates merged over stretches of rows against replicates of all rows at once."""

import random

import numpy as np
import pytest

from pairforge.operators import metrics


def grouped(s, y, w):
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[at], np.add.reduceat(w * y[:, None], at, axis=0), np.add.reduceat(w * (1 - y)[:, None], at, axis=0)


def area(s, y, w):
    """Twice the wins of one replicate, pair by pair."""
    return sum(wi * wj * (2 * (si > sj) + (si == sj)) for si, yi, wi in zip(s, y, w, strict=True) if yi for sj, yj, wj in zip(s, y, w, strict=True) if not yj)


@pytest.mark.parametrize("levels", [1, 2, 4, 50])
def test_stretches_cut_anywhere_merge_to_the_whole(levels):
    rng = np.random.default_rng(levels)
    for _ in range(20):
        n = int(rng.integers(1, 25))
        s, y, w = np.sort(rng.integers(0, levels, n)).astype(float), rng.integers(0, 2, n), rng.integers(0, 4, (n, 3))
        cuts = [0, *sorted(rng.integers(0, n + 1, 4).tolist()), n]
        merged = metrics.Replicates(3)
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = metrics.Replicates(3)
            for i in range(a, b, 2):
                part.add(*grouped(s[i : min(i + 2, b)], y[i : min(i + 2, b)], w[i : min(i + 2, b)]))
            merged.merge(part)
        assert merged.w.tolist() == [area(s, y, w[:, r]) for r in range(3)]
        assert merged.p.tolist() == (w * y[:, None]).sum(0).tolist() and merged.n.tolist() == (w * (1 - y)[:, None]).sum(0).tolist()


def test_weights_are_poisson_and_rows_apart():
    w = metrics.replicate_weights(np.arange(3000) * 7919, 400)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[0::2].ravel(), w[1::2].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_ends_do_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", int(rng.random() < 0.4), float(rng.choice([1, 1, 1, 2, 3]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, label_int int, score double")
    got = [metrics.bootstrap_merged(df.repartition(k), "id", 200, 0.9, 5).first() for k in (1, 3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got.append(metrics.bootstrap_merged(df, "id", 200, 0.9, 5).first())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]
    plain = metrics.auroc(df).first()[0]
    assert got[0].auroc_ci_low < plain < got[0].auroc_ci_high and got[0].auroc_ci_high - got[0].auroc_ci_low < 0.2
    one = metrics.bootstrap_merged(df.filter("label_int = 1"), "id", 20, 0.9, 5).first()
    assert one.auroc_ci_low is None
