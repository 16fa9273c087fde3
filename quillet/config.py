"""Options from a TOML file; keys it doesn't know are errors."""

from __future__ import annotations

import os
import tomllib
from dataclasses import fields, replace
from pathlib import Path

from quillet.operators.convert import CLI, Options

FILE = "quillet.toml"


def load(path: str, base: Options = CLI) -> Options:
    with open(path, "rb") as f:
        said = tomllib.load(f)
    protect = said.pop("protect", [])
    unknown = said.keys() - {f.name for f in fields(Options)}
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    critical = tuple(dict.fromkeys([*base.critical, *(p.lower() for p in protect)]))
    return replace(base, critical=critical, **said)


def discover(start: str = ".") -> Options:
    """From the file that QUILLET_CONFIG names, or the nearest one in a folder above; defaults without any."""
    if named := os.environ.get("QUILLET_CONFIG"):
        return load(named)
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / FILE).is_file():
            return load(str(folder / FILE))
    return CLI
