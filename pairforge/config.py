"""Run configuration: nested, immutable, checked when it is made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any, get_type_hints

FAMILIES = ("mild", "strong", "strong_held_out", "strong_held_out_2")
POLICIES = ("fallback", "strict_same_diagnosis_site")
MODELS = ("color_texture", "dinov2", "clip", "open_clip")
#: linear and mlp are fitted by mini-batches, ridge by sums in one pass; all over any number of pairs.
PREDICTORS = ("linear", "mlp", "ridge")


class ConfigError(ValueError):
    """A setting that is missing, of the wrong type or out of range."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class Fixture:
    lesions_per_split: int = 6
    stable_pairs_per_split: int = 3
    changing_pairs_per_split: int = 3
    image_size: int = 64
    source_dataset: str = "synthetic"

    def __post_init__(self) -> None:
        _need(self.lesions_per_split >= 4, "fixture.lesions_per_split must be at least 4")
        _need(min(self.stable_pairs_per_split, self.changing_pairs_per_split) >= 1, "fixture pairs per split must be positive")


@dataclass(frozen=True)
class Fractions:
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        parts = (self.train, self.val, self.test)
        _need(min(parts) > 0, "split fractions must be positive")
        _need(abs(sum(parts) - 1) <= 1e-6, "split fractions must sum to 1")


@dataclass(frozen=True)
class Dataset:
    name: str
    metadata_csv: str
    image_roots: tuple[str, ...]
    image_extensions: tuple[str, ...] = ("jpg", "jpeg", "png")
    stable_pairs_per_split: int = 1000
    changing_pairs_per_split: int = 1000
    split: Fractions = field(default_factory=Fractions)
    max_records: int | None = None
    nuisance_severity: str = "mild"
    nuisance_severity_eval: str | None = None
    changing_pair_policy: str = "fallback"

    def __post_init__(self) -> None:
        _need(bool(self.image_roots) and bool(self.image_extensions), "dataset needs image roots and extensions")
        _need(all(e.lower().removeprefix(".") for e in self.image_extensions), "an image extension is empty")
        _need(min(self.stable_pairs_per_split, self.changing_pairs_per_split) >= 1, "dataset pairs per split must be positive")
        _need(self.max_records is None or self.max_records >= 1, "dataset.max_records must be positive when set")
        _need(self.changing_pair_policy in POLICIES, f"dataset.changing_pair_policy must be one of {POLICIES}")
        for name in ("nuisance_severity", "nuisance_severity_eval"):
            if (value := getattr(self, name)) is not None:
                listed = [x.strip() for x in value.split(",") if x.strip()]
                _need(bool(listed) and set(listed) <= set(FAMILIES), f"dataset.{name} must list families of {FAMILIES}")


@dataclass(frozen=True)
class Model:
    model_id: str
    kind: str = "color_texture"
    model_name: str | None = None
    batch_size: int = 32

    def __post_init__(self) -> None:
        _need(self.kind in MODELS, f"unsupported embedding model kind: {self.kind}")
        _need(self.batch_size >= 1, f"embedding model {self.model_id}: batch_size must be positive")
        _need(self.kind == "color_texture" or self.model_name is not None, f"embedding model {self.model_id} requires model_name")


@dataclass(frozen=True)
class Training:
    model_id: str = "predictor"
    embedding_model_id: str | None = None
    epochs: int = 200
    batch_size: int = 32
    learning_rate: float = 0.05
    weight_decay: float = 0.001
    predictor: str = "linear"
    hidden_dim: int = 512
    optimizer: str = "sgd"

    def __post_init__(self) -> None:
        _need(min(self.epochs, self.batch_size, self.hidden_dim) >= 1, "training epochs, batch_size and hidden_dim must be positive")
        _need(self.learning_rate > 0 and self.weight_decay >= 0, "training.learning_rate must be positive and weight_decay not negative")
        _need(self.predictor in PREDICTORS, f"training.predictor must be one of {PREDICTORS}")
        _need(self.optimizer in ("sgd", "adam"), "training.optimizer must be 'sgd' or 'adam'")


@dataclass(frozen=True)
class Preprocessing:
    profile: str = "square_rgb"
    image_size: int = 224

    def __post_init__(self) -> None:
        _need(self.image_size >= 32, "preprocessing.image_size must be at least 32")


@dataclass(frozen=True)
class Metrics:
    bootstrap_samples: int = 1000
    ci_level: float = 0.95
    fixed_tpr: float = 0.8

    def __post_init__(self) -> None:
        _need(self.bootstrap_samples >= 1, "metrics.bootstrap_samples must be positive")
        _need(0.5 <= self.ci_level < 1 and 0 < self.fixed_tpr < 1, "metrics.ci_level must lie in [0.5, 1) and fixed_tpr in (0, 1)")


@dataclass(frozen=True)
class Config:
    run_id: str
    output_root: str = "runs"
    seed: int = 0
    fixture: Fixture | None = None
    dataset: Dataset | None = None
    embedding_models: tuple[Model, ...] = (Model("color_texture"),)
    training: Training = field(default_factory=Training)
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    metrics: Metrics = field(default_factory=Metrics)

    def __post_init__(self) -> None:
        _need((self.fixture is None) != (self.dataset is None), "exactly one of fixture and dataset is needed")

    @property
    def run_dir(self) -> str:
        return f"{self.output_root}/{self.run_id}"

    @property
    def tier(self) -> str:
        return "fixture" if self.fixture is not None else "public"


_NESTED = {"fixture": Fixture, "dataset": Dataset, "training": Training, "preprocessing": Preprocessing, "metrics": Metrics, "split": Fractions}


def _value(name: str, value: Any, hint: Any) -> Any:
    if name == "embedding_models":
        return tuple(_make(Model, v, "embedding_models") for v in value)
    if name in _NESTED and value is not None:
        return _make(_NESTED[name], value, name)
    text = str(hint)
    if "tuple" in text:
        return tuple(map(str, value))
    if value is None:
        return None
    if hint is float or "float" in text:
        _need(isinstance(value, int | float) and not isinstance(value, bool), f"{name} must be a number")
        return float(value)
    if hint is int or "int" in text:
        _need(isinstance(value, int) and not isinstance(value, bool), f"{name} must be a whole number")
        return value
    _need(isinstance(value, str | Path), f"{name} must be text")
    return str(value)


def _make(kind: type, data: Any, where: str) -> Any:
    _need(isinstance(data, Mapping), f"{where} must be a mapping")
    hints = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    unknown = set(data) - known
    _need(not unknown, f"{where} has unknown settings {sorted(unknown)}")
    try:
        return kind(**{k: _value(k, v, hints[k]) for k, v in data.items()})
    except TypeError as error:
        raise ConfigError(f"{where}: {error}") from None


def load(path: str, **overrides: Any) -> Config:
    """A configuration from a YAML mapping, at a path or a URI; overrides replace top-level settings."""
    import yaml

    from pairforge.sinks.files import open_store

    store, name = open_store(str(Path(path).resolve()) if "://" not in path else path)
    with store.open_input_file(name) as file:
        data = yaml.safe_load(file.read().decode())
    _need(isinstance(data, Mapping), f"{path} must hold a mapping")
    return _make(Config, {**data, **{k: v for k, v in overrides.items() if v is not None}}, "config")
