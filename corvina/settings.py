"""Settings: nested values by dotted names, with defaults."""

from __future__ import annotations

import json
from typing import Any


class Settings:
    """Values of a JSON document (or YAML, where a reader for it is installed), found by names such as "events.window_days"."""

    def __init__(self, values: dict | None = None) -> None:
        self.values = values or {}

    @classmethod
    def read(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml  # only where it is installed

            return cls(yaml.safe_load(text))
        return cls(json.loads(text))

    def get(self, name: str, default: Any = None) -> Any:
        """The value at a dotted name; ``default`` where any part of it is missing."""
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at
