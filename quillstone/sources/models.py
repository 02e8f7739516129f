"""A local registry of model folders: paths, checksums and sidecars, without a network."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path


def cache_dir(path: str | None = None) -> Path:
    return Path(path or os.environ.get("QUILLSTONE_CACHE") or Path.home() / ".cache" / "quillstone")


def checksum(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def available(path: str | None = None) -> list[str]:
    return sorted(p.parent.name for p in cache_dir(path).glob("*/model.json"))


def add(source: str, name: str, path: str | None = None, version: str = "") -> Path:
    """Copies a model file into the registry and writes its sidecar; replaces one of that name."""
    home = cache_dir(path) / name
    home.mkdir(parents=True, exist_ok=True)
    target = home / Path(source).name
    shutil.copyfile(source, target)
    (home / "model.json").write_text(json.dumps({"file": target.name, "sha256": checksum(target), "version": version}))
    return target


def info(name: str, path: str | None = None) -> dict:
    side = cache_dir(path) / name / "model.json"
    if not side.exists():
        raise KeyError(f"no model {name!r}; there are {available(path)}")
    return json.loads(side.read_text())


def find(name: str, path: str | None = None) -> Path:
    """A file as it is, or the model of that name, its checksum verified."""
    if os.path.isfile(name):
        return Path(name)
    side = info(name, path)
    target = cache_dir(path) / name / side["file"]
    if checksum(target) != side["sha256"]:
        raise ValueError(f"{target} is not what its sidecar says")
    return target


def version(name: str, path: str | None = None) -> str:
    return info(name, path)["version"]


def clear(name: str | None = None, path: str | None = None) -> None:
    for n in [name] if name else available(path):
        shutil.rmtree(cache_dir(path) / n, ignore_errors=True)
