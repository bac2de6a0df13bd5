"""Settings: YAML from a file or https address, and a.b.0.c=value overrides."""

from __future__ import annotations

from typing import Any

import yaml

#: Settings that are accepted and have no effect here.
IGNORED = ("memory_config", "batch_size", "validate_data", "conversation_field", "conversation_format", "nsfw_threshold")


def set_path(cfg: dict, path: str, value: Any) -> None:
    """Sets ``a.b.0.c``: numbers index lists, missing parts become dicts."""
    parts = path.split(".")
    at: Any = cfg
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        key: Any = int(part) if isinstance(at, list) else part
        if isinstance(at, list) and key == len(at):
            at.append(None)
        if last:
            at[key] = value
        else:
            if (at[key] if isinstance(at, list) else at.get(key)) is None:
                at[key] = {}
            at = at[key]


def load_config(source: str | dict, overrides: list[str] | dict | None = None) -> dict:
    if isinstance(source, dict):
        cfg = yaml.safe_load(yaml.safe_dump(source))
    elif source.startswith("https://"):
        from urllib.request import urlopen

        with urlopen(source, timeout=30) as f:
            cfg = yaml.safe_load(f.read())
    else:
        with open(source, encoding="utf-8") as f:
            cfg = yaml.safe_load(f)
    pairs = overrides.items() if isinstance(overrides, dict) else ((o.lstrip("-").split("=", 1)) for o in overrides or [])
    for path, value in pairs:
        set_path(cfg, path, yaml.safe_load(value) if isinstance(value, str) else value)
    return cfg or {}
