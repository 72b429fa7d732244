"""Settings, with the defaults of a run; a YAML file may override them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Weights:
    lines: float = 0.45
    files: float = 0.45
    api_break: float = 0.10


@dataclass
class Slicing:
    target_slices: int = 20
    distance_weights: Weights = field(default_factory=Weights)
    segment_gain: str = "log1p"
    force_first_release_tag: bool = True


@dataclass
class Parsing:
    extensions: dict = field(default_factory=lambda: {"python": [".py"], "java": [".java"]})


@dataclass
class Storage:
    existing_repo_action: str = "ask"


@dataclass
class Validation:
    min_code_files_per_slice: int = 1
    ast_parsing_success_rate_threshold: float = 0.9


@dataclass
class Config:
    slicing: Slicing = field(default_factory=Slicing)
    parsing: Parsing = field(default_factory=Parsing)
    storage: Storage = field(default_factory=Storage)
    validation: Validation = field(default_factory=Validation)


def _filled(kind, values: dict):
    """A settings object from nested values; names it doesn't know are left out."""
    out = kind()
    for f in fields(kind):
        if f.name in (values or {}):
            own = getattr(out, f.name)
            setattr(out, f.name, _filled(type(own), values[f.name]) if is_dataclass(own) else values[f.name])
    gain = getattr(out, "segment_gain", "log1p")
    if gain not in ("log1p", "sqrt"):
        raise ValueError(f"segment_gain: {gain}")
    return out


def load(path: str | None = None) -> Config:
    """The settings of a YAML file; the defaults if there is none."""
    if not path or not Path(path).exists():
        return Config()
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading settings from YAML needs PyYAML") from e
    return _filled(Config, yaml.safe_load(Path(path).read_text()) or {})
