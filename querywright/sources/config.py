"""Settings from a TOML file, which arguments override key by key."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace

FILE = "querywright.toml"


@dataclass(frozen=True)
class Config:
    schema: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    dialect: str | None = None
    format: str | None = None
    disable: list[str] = field(default_factory=list)
    schema_dir: str | None = None

    def over(self, **given) -> Config:
        """With the given values in place of these; empty ones do not count. Lists are replaced, not joined."""
        return replace(self, **{k: v for k, v in given.items() if v})


def read_config(path: str) -> Config:
    with open(path, "rb") as f:
        found = tomllib.load(f)
    known = {f.name for f in fields(Config)}
    if unknown := set(found) - known:
        raise ValueError(f"unknown keys in {path}: {', '.join(sorted(unknown))}")
    as_list = lambda v: [v] if isinstance(v, str) else v
    return Config(**{k: as_list(v) if k in ("schema", "files", "disable") else v for k, v in found.items()})


def find_config(start: str, name: str = FILE) -> str | None:
    """The nearest file of that name, from a folder upward."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(found := os.path.join(at, name)):
            return found
        if (up := os.path.dirname(at)) == at:
            return None
        at = up
