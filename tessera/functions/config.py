"""Configuration trees on the driver: layers, dotted access, stable hashes."""

from __future__ import annotations

import copy
import hashlib
import json
from typing import Any


def merge(base: dict, over: dict) -> dict:
    """A new tree in which mappings are merged and all else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def get(tree: dict, path: str, default: Any = None) -> Any:
    at: Any = tree
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def put(tree: dict, path: str, value: Any) -> None:
    *parents, last = path.split(".")
    for part in parents:
        tree = tree.setdefault(part, {})
    tree[last] = value


def load(layers: list[dict], overrides: list[str] = ()) -> dict:
    """Layers from general to special, then ``dotted.key=value`` with values read as JSON where they are."""
    out: dict = {}
    for layer in layers:
        out = merge(out, layer)
    for item in overrides:
        path, eq, text = item.partition("=")
        if not eq or not path:
            raise ValueError(f"not key=value: {item}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        put(out, path, value)
    if out.get("version", 1) != 1:
        raise ValueError(f"unknown version {out['version']}")
    return out


def stable_hash(tree: Any) -> str:
    return hashlib.sha256(json.dumps(tree, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
