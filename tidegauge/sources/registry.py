"""Registry of experiments: a YAML or JSON file with a mapping ``experiments`` from id to settings."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def read_registry(path: str) -> dict[str, Any]:
    """The experiments of a registry file; one without any is empty. YAML needs a YAML reader to be installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text) if text.strip() else None
    return dict((data or {}).get("experiments") or {})


def experiment_settings(path: str, name: str) -> dict[str, Any]:
    """Settings of one experiment; an unknown one is an error that lists those there are."""
    known = read_registry(path)
    if name not in known:
        raise KeyError(f"no experiment {name!r}; there are: {', '.join(sorted(known)) or 'none'}")
    return known[name]
