"""Configuration documents of pipelines."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str) -> dict:
    """A JSON document, or YAML where that library is installed; it must be a mapping."""
    text, suffix = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError(f"{path}: YAML needs a library that is not installed; use JSON") from missing
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: a configuration is a mapping")
    return value
