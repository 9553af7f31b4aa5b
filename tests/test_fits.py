"""Fits of tables against fits of matrices at the same batches."""

import numpy as np
import pytest

from pairforge.operators import predictor as P


def frame(spark, x, y):
    return spark.createDataFrame([(f"p{i:05d}", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pair_id string, x array<float>, y array<float>")


def vectors(n, dim=6):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return x, (x @ rng.normal(size=(dim, dim)) * 0.3 + 0.2).astype(np.float32)


@pytest.mark.parametrize("kind,optimizer", [("linear", "sgd"), ("mlp", "sgd"), ("mlp", "adam")])
def test_a_table_is_fitted_like_matrices(spark, kind, optimizer):
    x, y = vectors(75)
    keys = [f"p{i:05d}" for i in range(len(x))]
    common = {"seed": 3, "epochs": 3, "batch": 20, "rate": 0.05, "decay": 0.01}
    own = {"hidden": 8, "optimizer": optimizer} if kind == "mlp" else {}
    state = P.fit_stored(frame(spark, x, y), frame(spark, x[:9], y[:9]), kind, **common, **own)
    if kind == "linear":
        model = P.Linear(P.Linear.start(6, np.random.default_rng(3 + P.SEED_OFFSETS["linear"])), 0.05, 0.01)
    else:
        model = P.Mlp(P.Mlp.start(6, np.random.default_rng(3 + P.SEED_OFFSETS["mlp_init"]), 8), 0.05, 0.01, optimizer)
    want = P.fit(model, P.Matrices(x, y, 20, lambda e: P.hashed_order(keys, 3, e)), P.Matrices(x[:9], y[:9]), 3)
    for name in model.names:
        assert state[name] == pytest.approx(want[name], abs=2e-5)
    assert [h["epoch"] for h in state["history"]] == [1, 2, 3]
    for got, h in zip(state["history"], want["history"], strict=True):
        assert got["train_loss"] == pytest.approx(h["train_loss"], abs=1e-5) and got["val_loss"] == pytest.approx(h["val_loss"], abs=1e-5)
    assert state["history"][-1]["train_loss"] < state["history"][0]["train_loss"]


def test_more_pairs_than_the_driver_gathers(spark):
    n = P.MOST_PAIRS + 1
    ids = spark.range(n)
    pairs = ids.selectExpr("cast(id as string) as pair_id", "array(cast(id % 7 - 3 as float), cast(id % 5 - 2 as float)) as x", "array(cast(id % 5 - 2 as float), cast(2 * (id % 7 - 3) as float)) as y")
    with pytest.raises(ValueError, match="fit_stored"):
        P.matrices(pairs)
    state = P.fit_stored(pairs, pairs.limit(10), "linear", seed=1, epochs=2, batch=n // 3, rate=0.3, decay=0.0)
    assert state["history"][-1]["train_loss"] < 0.2 * state["history"][0]["train_loss"] + 1.0
    assert np.abs(state["weight"] - [[0, 2], [1, 0]]).max() < np.abs(np.eye(2) - [[0, 2], [1, 0]]).max()
