"""Run configuration: YAML files merged over defaults, checked, and identified by a hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

from quoin.operators.splits import WalkForward


@dataclass(frozen=True)
class Preprocessing:
    """Winsor bounds are percents, as people write them; operators take fractions."""

    low_percent: float = 0.5
    high_percent: float = 99.5
    scaler: str = "zscore"
    neutralizer: str = "none"

    def __post_init__(self) -> None:
        if not 0 <= self.low_percent < self.high_percent <= 100:
            raise ValueError("winsor percents must be ordered within 0 and 100")
        if self.scaler not in ("none", "zscore", "robust_zscore", "percentile_rank") or self.neutralizer not in ("none", "sector", "beta", "sector_plus_beta"):
            raise ValueError(f"unknown preprocessing: {self.scaler}, {self.neutralizer}")

    @property
    def winsor(self) -> tuple[float, float]:
        return self.low_percent / 100, self.high_percent / 100


@dataclass(frozen=True)
class Model:
    name: str = "ridge"
    alphas: tuple[float, ...] = (0.1, 1.0, 10.0)
    l1_ratios: tuple[float, ...] = (0.2, 0.5, 0.8)
    trials: int = 16
    seed: int = 42
    features: tuple[str, ...] = ("mom_21_ex1", "rev_1", "vol_21", "ret_5")
    label: str = "label_excess_5d_oo"


@dataclass(frozen=True)
class Config:
    splits: WalkForward = field(default_factory=lambda: WalkForward(train=12, valid=2, test=1, step=1))
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    model: Model = field(default_factory=Model)

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _build(kind: type, values: dict[str, Any], where: str, strict: bool, warnings: list[str]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        if strict:
            raise ValueError(f"unknown settings in {where}: {unknown}")
        warnings.append(f"ignored settings in {where}: {unknown}")
    base = kind() if kind is not WalkForward else Config().splits
    out = {}
    for name in known:
        now = getattr(base, name)
        value = values.get(name, now)
        if is_dataclass(now) and isinstance(value, dict):
            value = _build(type(now), value, f"{where}.{name}", strict, warnings)
        elif isinstance(now, tuple) and isinstance(value, list):
            value = tuple(value)
        out[name] = value
    return kind(**out)


def load_config(paths: Sequence[str] = (), strict: bool = True) -> tuple[Config, list[str]]:
    """(config, warnings) of the YAML files, later ones over earlier ones, section by section; unknown settings are errors, or warnings."""
    merged: dict[str, Any] = {}
    for path in paths:
        import yaml

        with open(path, encoding="utf-8") as lines:
            for section, values in (yaml.safe_load(lines) or {}).items():
                merged[section] = {**merged.get(section, {}), **values} if isinstance(values, dict) else values
    warnings: list[str] = []
    return _build(Config, merged, "config", strict, warnings), warnings


def snapshot(config: Config) -> dict:
    """The settings as they were, flat, with their hash and the type of each, as a run keeps them."""
    values: dict[str, Any] = {}
    for section, own in asdict(config).items():
        values |= {f"{section}.{k}": v for k, v in own.items()}
    return {"values": values, "types": {k: type(v).__name__ for k, v in values.items()}, "hash": config.hash}
