"""Settings from defaults, a TOML file and the caller, the later ones first."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    inputs: tuple[str, ...] = ()
    output: str | None = None
    rejected: str | None = None
    library: str | None = None
    #: A SQL expression on `line` that gives the key by which lines are the same.
    key: str = "line"
    kind: str = "parquet"
    sniff: bool = True
    since: str | None = None
    dry: bool = False
    max_line_bytes: int = 4096
    rows_per_part: int = 100_000_000
    hits_per_chunk: int | None = None
    rules_allow: tuple[str, ...] = ()
    rules_deny: tuple[str, ...] = ()


_PATHS = ("output", "rejected", "library")


def load(path: str | None = None, given: dict[str, Any] | None = None, section: str = "millrace") -> Settings:
    """Settings from the file's section, overridden by what is given (None is not given). A file that is named must
    be there; its relative paths start from its own folder. Unknown names are an error."""
    names = {f.name for f in fields(Settings)}
    out = Settings()
    if path is not None:
        with open(path, "rb") as f:
            found = tomllib.load(f).get(section, {})
        base = os.path.dirname(os.path.abspath(path))
        local = lambda p: p if os.path.isabs(p) or "://" in p else os.path.join(base, p)
        found = {k: local(v) if k in _PATHS else tuple(map(local, v)) if k == "inputs" else tuple(v) if isinstance(v, list) else v for k, v in found.items()}
        if unknown := set(found) - names:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = replace(out, **found)
    given = {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := set(given) - names:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(out, **given)
