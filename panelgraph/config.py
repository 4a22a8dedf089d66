"""The study's settings as frozen dataclasses; unknown keys are refused."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class PanelConfig:
    unit: str = "week"
    assets: int = 10


@dataclass(frozen=True)
class GraphConfig:
    window: int = 20
    tau: float = 0.2
    alpha: float = 0.05
    permutations: int = 500
    calibration_windows: int = 24
    seed: int = 42


@dataclass(frozen=True)
class FeatureConfig:
    lags: int = 5
    vol_windows: tuple[int, ...] = (5, 20)
    volume_window: int = 20


@dataclass(frozen=True)
class FoldConfig:
    train: int = 104
    val: int = 26
    test: int = 26
    step: int = 26
    mode: str = "rolling"
    horizon: int = 1


@dataclass(frozen=True)
class ModelConfig:
    hidden: tuple[int, ...] = (16, 32)
    dropout: tuple[float, ...] = (0.2, 0.5)
    seeds: int = 5
    epochs: int = 300
    fixed_lag: int = 5


@dataclass(frozen=True)
class StudyConfig:
    panel: PanelConfig = field(default_factory=PanelConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    folds: FoldConfig = field(default_factory=FoldConfig)
    models: ModelConfig = field(default_factory=ModelConfig)
    costs_bps: tuple[float, ...] = (0.0, 10.0)
    periods: int = 52


def from_dict(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from nested dictionaries; an unknown key is a TypeError."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise TypeError(f"{kind.__name__} has no setting {sorted(extra)}")
    defaults = kind()
    out = {}
    for name, value in values.items():
        now = getattr(defaults, name)
        out[name] = from_dict(type(now), value) if is_dataclass(now) else tuple(value) if isinstance(now, tuple) else value
    return kind(**out)


def load_config(path: str) -> StudyConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(StudyConfig, yaml.safe_load(f) or {})


def config_hash(config: StudyConfig) -> str:
    """SHA-1 of the settings as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()
