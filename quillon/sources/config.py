"""Settings from JSON (and YAML, where a reader is installed) with exact keys: a missing or unknown key, or a value of another kind, is refused."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def load(path: str, keys: dict[str, type | tuple[type, ...] | dict]) -> dict[str, Any]:
    """The settings of a file. keys: for each key the kind of its value, or the keys of a nested object."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("no YAML reader is installed") from missing
        data = yaml.safe_load(text)
    else:
        data = json.loads(text, object_pairs_hook=_once)
    return check(data, keys, path)


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def check(data: Any, keys: dict, where: str) -> dict[str, Any]:
    if not isinstance(data, dict):
        raise ValueError(f"{where}: not an object")
    if missing := sorted(set(keys) - set(data)):
        raise ValueError(f"{where}: missing {missing}")
    if unknown := sorted(set(data) - set(keys)):
        raise ValueError(f"{where}: unknown {unknown}")
    for name, kind in keys.items():
        if isinstance(kind, dict):
            check(data[name], kind, f"{where}: {name}")
        elif not isinstance(data[name], kind) or isinstance(data[name], bool) and kind in (int, float, (int, float)):
            raise ValueError(f"{where}: {name} is of another kind")
    return data
