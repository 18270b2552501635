"""Settings object (S7): a frozen options record with a default for every field."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    strip_buttons: bool = True
    include_metadata: bool = True  # front matter on/off (documented switch)
    date_format: str = "%Y-%m-%d"
    heading_style: str = "ATX"  # ATX or SETEXT
    max_filename_length: int = 50
    smart_titles: bool = True
    version: str = "3.0.0"
    # run date written into front matter; a literal so results are deterministic
    run_date: str = "2026-01-01"
    # how the node table and the cleaned region rows are materialised: "checkpoint", "persist" or "none"
    materialize: str = "checkpoint"

    def with_(self, **kw) -> "Options":
        return replace(self, **kw)


_FIELDS = {
    "strip_buttons": bool,
    "include_metadata": bool,
    "date_format": str,
    "heading_style": str,
    "max_filename_length": int,
    "smart_titles": bool,
}


def load_options(path: str | Path | None = None) -> Options:
    """Read JSON settings; a missing file or malformed JSON gives all defaults."""
    if path is None:
        return Options()
    p = Path(path)
    if not p.exists():
        return Options()
    try:
        raw = json.loads(p.read_text(encoding="utf-8"))
    except (json.JSONDecodeError, UnicodeDecodeError):
        return Options()
    if not isinstance(raw, dict):
        return Options()
    settings = raw.get("settings", {}) or {}
    kw = {}
    for name, typ in _FIELDS.items():
        if name in settings and isinstance(settings[name], typ):
            kw[name] = settings[name]
    if isinstance(raw.get("version"), str):
        kw["version"] = raw["version"]
    return Options(**kw)
