"""Settings: defaults, a TOML file over them, and partial changes that are checked before they are written."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from lumenary.operators.changes import STAGES


@dataclass
class Caption:
    provider: str = "first_words"
    plugins: list = field(default_factory=list)


@dataclass
class Embed:
    provider: str = "hashed"
    text_provider: str = ""
    model: str = "m64"
    dim: int = 64
    min_score: float = 0.07
    rel_score: float = 0.6
    plugins: list = field(default_factory=list)


@dataclass
class Faces:
    provider: str = ""
    cluster_eps: float = 0.42
    min_cluster_size: int = 3
    suggest_min_similarity: float = 0.35


@dataclass
class Sidecars:
    location: str = "app"


@dataclass
class Settings:
    caption: Caption = field(default_factory=Caption)
    embed: Embed = field(default_factory=Embed)
    faces: Faces = field(default_factory=Faces)
    sidecar: Sidecars = field(default_factory=Sidecars)
    auto_process: list = field(default_factory=lambda: ["thumbs"])
    scan_workers: int = 8

    def __post_init__(self):
        odd = [s for s in self.auto_process if s not in STAGES]
        if odd:
            raise ValueError(f"unknown stages {odd}; there are {', '.join(STAGES)}")
        if self.sidecar.location not in ("app", "beside"):
            raise ValueError(f"sidecars go to app or beside, not {self.sidecar.location!r}")


def _made(kind, values: dict):
    """An instance of a dataclass; unknown names are left aside, wrong types an error."""
    known = {}
    for f in fields(kind):
        if f.name not in values:
            continue
        default = getattr(kind(), f.name)
        value = _made(type(default), values[f.name]) if is_dataclass(default) and isinstance(values[f.name], dict) else values[f.name]
        if isinstance(default, float) and type(value) is int:
            value = float(value)
        if type(value) is not type(default):
            raise ValueError(f"{f.name} has to be {type(default).__name__}, not {value!r}")
        known[f.name] = value
    return kind(**known)


def of(values: dict) -> Settings:
    """Settings from a table; what stands under [server] counts as if it stood at the top."""
    server = values.get("server")
    return _made(Settings, {k: v for k, v in values.items() if k != "server"} | (server if isinstance(server, dict) else {}))


def load(path: str) -> Settings:
    return of(_table(path))


def _table(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        return tomllib.load(f)


def merged(old: dict, new: dict) -> dict:
    """`old` with the values of `new`, table by table."""
    return old | {k: merged(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}


def text(values: dict) -> str:
    """TOML of a table of values, lists and tables of these."""
    plain = [f"{k} = {json.dumps(v)}" for k, v in values.items() if not isinstance(v, dict)]
    tables = [f"\n[{k}]\n" + text(v) for k, v in values.items() if isinstance(v, dict)]
    return "".join(x + "\n" for x in plain) + "".join(tables)


def save(path: str, change: dict) -> Settings:
    """Merge a partial change into the file. Values are checked first: a wrong one leaves the file as it was. Settings
    that this version doesn't know stay."""
    values = merged(_table(path), change)
    out = of(values)
    first = f"{path}.tmp"
    with open(first, "w") as f:
        f.write(text(merged(asdict(out), values)))
    os.replace(first, path)
    return out
