"""Predictors of target vectors from context vectors, and their scores.

A fit by mini-batches is one loop over sums of gradients, wherever these are made: of matrices on
the driver, in the order of one NumPy generator, or of tables of any size, where the tasks that
read a batch add up its gradients and an epoch's order is that of hashes. ``ridge`` is the closed
form. Prediction and scoring are distributed for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.order import RANGE_BITS, in_order
from pairforge.functions.vectors import EPSILON
from pairforge.operators.checks import missing_vectors
from pairforge.schema import SEED_OFFSETS
from pairforge.sinks.scratch import new_path, remove, stored

#: Pairs that are gathered for a fit on the driver; more are fitted where they are.
MOST_PAIRS = 200_000


def recorded(epoch: int, epochs: int) -> bool:
    """The first and last epoch and each tenth of the way."""
    return epoch in (1, epochs) or epoch % max(1, epochs // 10) == 0


def recorded_at(epoch: Column, epochs: int) -> Column:
    return epoch.isin(1, epochs) | (epoch % max(1, epochs // 10) == 0)


def pair_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with both vectors, ``x`` and ``y``. A pair without a vector is an error, not a lost row."""
    lacking = missing_vectors(pairs, vectors).limit(5).collect()
    if lacking:
        raise KeyError(f"no vector for {[r.image_id for r in lacking]}")
    context = vectors.select(F.col("image_id").alias("context_image_id"), F.col("vector").alias("x"))
    target = vectors.select(F.col("image_id").alias("target_image_id"), F.col("vector").alias("y"))
    return pairs.join(context, "context_image_id").join(target, "target_image_id")


def matrices(pairs: DataFrame, order: str = "pair_id") -> tuple[np.ndarray, np.ndarray]:
    """The vectors of at most MOST_PAIRS pairs, in order, as float32 matrices on the driver."""
    rows = pairs.orderBy(order).select("x", "y").limit(MOST_PAIRS + 1).toArrow()
    if rows.num_rows > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs: fit them where they are, by fit_stored()")
    return tuple(np.array(rows.column(c).to_pylist(), np.float32).reshape(rows.num_rows, -1) for c in ("x", "y"))


def mean_squared_error(pairs: DataFrame) -> DataFrame:
    """loss, over all numbers of the vectors x and y, and how many numbers there are; added up where the pairs are."""
    square = F.zip_with("x", "y", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    sums = pairs.agg(F.sum(F.aggregate(square, F.lit(0.0), lambda t, v: t + v)).alias("total"), F.sum(F.size("x")).alias("numbers"))
    return sums.select((F.col("total") / F.col("numbers")).alias("loss"), "numbers")


def scaled_identity(dim: int, scale: float = 1.0) -> dict[str, Any]:
    """The linear predictor that moves nothing: where fits begin, and what they are compared with."""
    return {"kind": "linear", "weight": scale * np.eye(dim, dtype=np.float32), "bias": np.zeros(dim, np.float32), "history": []}


Sums = dict[str, np.ndarray]


class Linear:
    """A linear map near identity. The weights' gradient is a mean over all entries, the bias's one
    over rows, and the pull to identity is not averaged."""

    kind, names = "linear", ("weight", "bias")

    def __init__(self, state: dict[str, Any], rate: float, decay: float) -> None:
        self.state = {k: state[k] for k in self.names}
        self.rate, self.decay, self.eye = rate, decay, np.eye(len(state["bias"]), dtype=state["bias"].dtype)

    @classmethod
    def start(cls, dim: int, rng: np.random.Generator) -> dict[str, Any]:
        return {"weight": np.eye(dim, dtype=np.float32) + rng.normal(0.0, 0.005, (dim, dim)).astype(np.float32), "bias": np.zeros(dim, np.float32)}

    @staticmethod
    def sums(state: dict[str, Any], x: np.ndarray, y: np.ndarray) -> Sums:
        """What rows add to a step and to the loss."""
        error = x @ state["weight"] + state["bias"] - y
        return {"weight": x.T @ error, "bias": error.sum(axis=0), "square": np.sum(error * error, dtype=float)}

    def step(self, sums: Sums, rows: int) -> None:
        kind, dim = self.eye.dtype, len(self.eye)
        weight = sums["weight"] * (2.0 / (rows * dim)) + 2.0 * self.decay * (self.state["weight"] - self.eye)
        bias = sums["bias"] * (2.0 / rows)
        self.state = {"weight": (self.state["weight"] - self.rate * weight).astype(kind), "bias": (self.state["bias"] - self.rate * bias).astype(kind)}

    def loss(self, sums: Sums, rows: int) -> float:
        """Mean squared error plus decay times the mean squared distance of the weights from identity."""
        return float(sums["square"] / (rows * len(self.eye)) + self.decay * np.mean((self.state["weight"] - self.eye) ** 2))


class Mlp:
    """x + W2 relu(W1 x + b1) + b2, by plain or Adam steps; decay is added to the gradients of both kinds."""

    kind, names = "mlp", ("w1", "b1", "w2", "b2")

    def __init__(self, state: dict[str, Any], rate: float, decay: float, optimizer: str = "sgd") -> None:
        if optimizer not in ("sgd", "adam"):
            raise ValueError(f"unknown optimizer: {optimizer}")
        self.state = {k: state[k] for k in self.names}
        self.rate, self.decay, self.optimizer, self.steps = rate, decay, optimizer, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.state.items()} for _ in range(2))

    @classmethod
    def start(cls, dim: int, rng: np.random.Generator, hidden: int = 512) -> dict[str, Any]:
        p = {
            "w1": rng.uniform(-1, 1, (dim, hidden)) / np.sqrt(dim), "b1": np.zeros(hidden),
            "w2": rng.uniform(-1, 1, (hidden, dim)) * 0.01 / np.sqrt(hidden), "b2": np.zeros(dim),
        }
        return {k: v.astype(np.float32) for k, v in p.items()}

    @staticmethod
    def sums(state: dict[str, Any], x: np.ndarray, y: np.ndarray) -> Sums:
        h = x @ state["w1"] + state["b1"]
        live = np.maximum(h, 0)
        error = x + live @ state["w2"] + state["b2"] - y
        back = (error @ state["w2"].T) * (h > 0)
        return {"w2": live.T @ error, "b2": error.sum(axis=0), "w1": x.T @ back, "b1": back.sum(axis=0), "square": np.sum(error * error, dtype=float)}

    def step(self, sums: Sums, rows: int) -> None:
        self.steps += 1
        dim, now = len(self.state["b2"]), {}
        for k, p in self.state.items():
            g = sums[k] * (2.0 / (rows * dim)) + self.decay * p
            if self.optimizer == "adam":
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                g = self.first[k] / (1 - 0.9**self.steps) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            now[k] = (p - self.rate * g).astype(p.dtype)
        self.state = now

    def loss(self, sums: Sums, rows: int) -> float:
        return float(sums["square"] / (rows * len(self.state["b2"])))


class Matrices:
    """Batches of two matrices on the driver; ``order`` gives the order of rows in an epoch."""

    def __init__(self, x: np.ndarray, y: np.ndarray, batch: int = 1, order: Callable[[int], np.ndarray] | None = None) -> None:
        self.x, self.y, self.batch, self.order = x, y, batch, order

    def batches(self, epoch: int, model: Linear | Mlp) -> Iterator[tuple[Sums, int]]:
        order = self.order(epoch)
        for at in range(0, len(order), self.batch):
            rows = order[at : at + self.batch]
            yield model.sums(model.state, self.x[rows], self.y[rows]), len(rows)

    def whole(self, model: Linear | Mlp) -> tuple[Sums, int]:
        return model.sums(model.state, self.x, self.y), len(self.x)


def hashed_order(keys: list[str], seed: int, epoch: int) -> np.ndarray:
    """The order that Stored takes rows in: by md5(seed/epoch/key), then key."""
    digests = [hashlib.md5(f"{seed}/{epoch}/{k}".encode()).hexdigest() for k in keys]
    return np.array(sorted(range(len(keys)), key=lambda i: (digests[i], keys[i])), np.int64)


class Stored:
    """Batches of a table (pair_id, x, y) of any number of rows.

    An epoch writes the rows in the order of md5(seed/epoch/pair_id), in sampled ranges. A batch
    is a stretch of that order: only the files and row groups that hold it are read, and each task
    sends one sum of gradients for all rows that it has. A step is a job, so batches should hold
    thousands of rows. What is written of an epoch goes when the next one begins.
    """

    def __init__(self, pairs: DataFrame, seed: int, batch: int) -> None:
        self.pairs, self.seed, self.batch = stored(pairs.select("pair_id", "x", "y"), "fit"), seed, batch

    def batches(self, epoch: int, model: Linear | Mlp) -> Iterator[tuple[Sums, int]]:
        digest = F.md5(F.concat_ws("/", F.lit(str(self.seed)), F.lit(str(epoch)), "pair_id"))
        spark = self.pairs.sparkSession
        path = new_path(spark, "epoch")
        placed = in_order(self.pairs.withColumn("_md5", digest), ["_md5", "pair_id"], path)
        sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row a range
        starts, at = [], 0
        for r in sorted(sizes):
            starts.append((r, at))
            at += sizes[r]
        try:
            for low in range(0, at, self.batch):
                high = min(low + self.batch, at)
                parts = [(r, max(low, first) - first, min(high, first + sizes[r]) - first) for r, first in starts]
                chosen = [F.col("_place").between((r << RANGE_BITS) + a, (r << RANGE_BITS) + b - 1) for r, a, b in parts if a < b]
                yield reduce_sums(placed.filter(reduce(lambda x, y: x | y, chosen)), model), high - low
        finally:
            remove(spark, path)

    def whole(self, model: Linear | Mlp) -> tuple[Sums, int]:
        return reduce_sums(self.pairs, model), self.pairs.count()


def reduce_sums(rows: DataFrame, model: Linear | Mlp) -> Sums:
    """model.sums() over all rows (x, y); a task sends one row for each array, of double precision."""
    sc, sums = rows.sparkSession.sparkContext, model.sums
    shared = sc.broadcast(model.state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x, y = (np.array(b.column(i).to_pylist(), np.float32).reshape(b.num_rows, -1) for i in (0, 1))
                for k, v in sums(shared.value, x, y).items():
                    total[k] = total.get(k, 0.0) + np.asarray(v, float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["name", "sum"])

    shapes = {k: v.shape for k, v in model.state.items()} | {"square": ()}
    out = {k: np.zeros(shape) for k, shape in shapes.items()}
    for r in rows.select("x", "y").mapInArrow(run, "name string, sum binary").toLocalIterator():  # a few arrays a task
        out[r.name] += np.frombuffer(r["sum"], float).reshape(shapes[r.name])
    shared.destroy()
    return out


def fit(model: Linear | Mlp, train: Matrices | Stored, val: Matrices | Stored, epochs: int) -> dict[str, Any]:
    """The model's state after all batches of all epochs, with the losses of the recorded ones."""
    history = []
    for epoch in range(1, epochs + 1):
        for sums, rows in train.batches(epoch, model):
            model.step(sums, rows)
        if recorded(epoch, epochs):
            history.append({"epoch": epoch, "train_loss": model.loss(*train.whole(model)), "val_loss": model.loss(*val.whole(model))})
    return {"kind": model.kind, **model.state, "history": history}


def fit_linear(x: np.ndarray, y: np.ndarray, val: tuple[np.ndarray, np.ndarray], *, seed: int, epochs: int, batch: int, rate: float, decay: float) -> dict[str, Any]:
    """A linear map from matrices, whose start and batches are drawn from one NumPy generator."""
    rng = np.random.default_rng(seed + SEED_OFFSETS["linear"])
    model = Linear(Linear.start(x.shape[1], rng), rate, decay)
    return fit(model, Matrices(x, y, batch, lambda _: rng.permutation(len(x))), Matrices(*val), epochs)


def fit_mlp(x: np.ndarray, y: np.ndarray, val: tuple[np.ndarray, np.ndarray], *, seed: int, epochs: int, batch: int, rate: float, decay: float, hidden: int = 512, optimizer: str = "sgd") -> dict[str, Any]:
    """An MLP from matrices, with a generator for its start and one for its batches."""
    init, draws = np.random.default_rng(seed + SEED_OFFSETS["mlp_init"]), np.random.default_rng(seed + SEED_OFFSETS["mlp_batches"])
    model = Mlp(Mlp.start(x.shape[1], init, hidden), rate, decay, optimizer)
    return fit(model, Matrices(x, y, batch, lambda _: draws.permutation(len(x))), Matrices(*val), epochs)


def fit_stored(pairs: DataFrame, val: DataFrame, kind: str, *, seed: int, epochs: int, batch: int, rate: float, decay: float, hidden: int = 512, optimizer: str = "sgd", start: dict[str, Any] | None = None) -> dict[str, Any]:
    """Either predictor from tables (pair_id, x, y) of any size; batches follow hashes, not a generator.

    ``start`` is a state to begin with; without it, the one that the fit of matrices begins with.
    """
    dim = pairs.select(F.size("x")).first()[0]
    if kind == "linear":
        model = Linear(start or Linear.start(dim, np.random.default_rng(seed + SEED_OFFSETS["linear"])), rate, decay)
    else:
        model = Mlp(start or Mlp.start(dim, np.random.default_rng(seed + SEED_OFFSETS["mlp_init"]), hidden), rate, decay, optimizer)
    return fit(model, Stored(pairs, seed, batch), Stored(val, seed, batch), epochs)


def ridge(pairs: DataFrame, penalty: float, dim: int) -> dict[str, Any]:
    """The exact minimum of squared error plus penalty * |W - I|^2, from sums made where the pairs are.

    A different estimator from fit_linear: it has no steps and no bias. Only dim x dim sums
    leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy = np.zeros((dim, dim)), np.zeros((dim, dim))
        for b in batches:
            x, y = (np.array(b.column(i).to_pylist(), float).reshape(b.num_rows, dim) for i in (0, 1))
            xx += x.T @ x
            xy += x.T @ y
        row = np.repeat(np.arange(dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.tile(np.arange(dim), dim)), pa.array(xx.ravel()), pa.array(xy.ravel())], ["i", "j", "xx", "xy"])

    sums = pairs.select("x", "y").mapInArrow(run, "i long, j long, xx double, xy double").groupBy("i", "j").agg(F.sum("xx").alias("xx"), F.sum("xy").alias("xy")).toPandas()
    xx, xy = np.zeros((dim, dim)), np.zeros((dim, dim))
    xx[sums["i"], sums["j"]], xy[sums["i"], sums["j"]] = sums["xx"], sums["xy"]
    eye = np.eye(dim)
    weight = np.linalg.solve(xx + penalty * eye, xy + penalty * eye)
    return {"kind": "linear", "weight": weight.astype(np.float32), "bias": np.zeros(dim, np.float32), "history": []}


def predict(x: np.ndarray, state: dict[str, Any]) -> np.ndarray:
    if state["kind"] == "linear":
        return x @ state["weight"] + state["bias"]
    return x + np.maximum(x @ state["w1"] + state["b1"], 0) @ state["w2"] + state["b2"]


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length <= EPSILON, 1.0, length)


def score(pairs: DataFrame, state: dict[str, Any]) -> DataFrame:
    """pairs (with x and y) plus ``prediction``, of length 1, and ``score``, its cosine distance from y."""
    arrays = {k: v for k, v in state.items() if k != "history"}
    shared = pairs.sparkSession.sparkContext.broadcast(arrays)
    at = [pairs.columns.index(c) for c in ("x", "y")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.array(b.column(i).to_pylist(), np.float32).reshape(b.num_rows, -1) for i in at)
            made = _unit(predict(x, shared.value))
            far = 1.0 - np.clip((made.astype(float) * _unit(y.astype(float))).sum(axis=1), -1.0, 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(made.astype(np.float32)), pa.list_(pa.float32())), pa.array(far, pa.float64())], [*b.schema.names, "prediction", "score"])

    schema = pairs.withColumns({"prediction": F.lit(None).cast("array<float>"), "score": F.lit(None).cast("double")}).schema
    return pairs.mapInArrow(run, schema)
