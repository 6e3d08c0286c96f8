"""Indexing settings from a TOML file in the source tree's root."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from weft.operators import extract, java

FILE_NAME = ".weft.toml"
# Folders that are left out, and the generated sources that are let in again.
EXCLUDED_DIRS = ("node_modules", "target", "build", "dist", ".gradle", ".git", ".claude", ".weft")
GENERATED = ("build/generated/sources",)


@dataclass
class Config:
    """Short lists and numbers in the file replace these; the long lists have ``extra_`` settings that add to them."""

    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    generated_sources: tuple[str, ...] = GENERATED
    excluded_patterns: tuple[str, ...] = ()
    max_file_bytes: int = 2 * 1024 * 1024
    endpoint_annotations: tuple[str, ...] = java.ENDPOINT_ANNOTATIONS
    endpoint_interfaces: tuple[str, ...] = java.ENDPOINT_INTERFACES
    schedulers: tuple[str, ...] = java.SCHEDULERS
    annotations: tuple[str, ...] = java.ANNOTATIONS
    no_annotations: tuple[str, ...] = java.NO_ANNOTATIONS
    field_noise: tuple[str, ...] = extract.FIELD_NOISE
    impact_limit: int = 100
    search_limit: int = 1000
    ignored: tuple[str, ...] = field(default=(".gitignore", ".ignore"))

    def extraction(self) -> dict:
        """What the extractors take."""
        return {k: list(getattr(self, k)) for k in ("endpoint_annotations", "endpoint_interfaces", "schedulers", "annotations", "no_annotations", "field_noise")}


ADDABLE = ("excluded_dirs", "annotations", "field_noise")


def load(root: str | Path) -> Config:
    """Settings of the tree; none without a file, an error with a malformed one."""
    path = Path(root) / FILE_NAME
    return parse(path.read_text("utf-8")) if path.exists() else Config()


def parse(text: str) -> Config:
    found = tomllib.loads(text)
    flat = {k: v for section in [found, *(v for v in found.values() if isinstance(v, dict))] for k, v in section.items() if not isinstance(v, dict)}
    known = {f.name: f for f in fields(Config)}
    out = Config()
    for key, value in flat.items():
        name = key.removeprefix("extra_")
        if name not in known or (key != name and name not in ADDABLE):
            raise ValueError(f"unknown setting: {key}")
        now = getattr(out, name)
        if isinstance(now, tuple) != isinstance(value, list):
            raise ValueError(f"wrong type of setting: {key}")
        if isinstance(now, tuple):
            value = tuple(dict.fromkeys([*now, *value])) if key != name else tuple(value)
        elif not isinstance(value, int) or isinstance(value, bool):
            raise ValueError(f"wrong type of setting: {key}")
        setattr(out, name, value)
    return out
