"""Typed run settings: defaults, then a ``key = value`` file, then command-line flags."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class SpatialConfig:
    """One frozen record of what a run needs; later sources win."""

    input: str = ""
    output: str = ""
    min_pieces: int = 8
    leaf_size: int = 16
    link_factor: float = 0.2
    min_members: int = 1
    period: float = 0.0
    theta: float = 0.7
    time_step: float = 0.01
    iterations: int = 1
    softening: float = -1.0  # below zero: keep each point's own

    def updated(self, values: dict[str, str], source: str) -> SpatialConfig:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        known = {}
        for key, text in values.items():
            if key not in kinds:
                warnings.warn(f"{source}: unknown setting {key!r}", stacklevel=2)
                continue
            known[key] = kinds[key](text)
        return replace(self, **known)


def parse_file(text: str) -> dict[str, str]:
    """``key = value`` lines; ``#`` starts a comment; white space around is dropped; a repeated key is an error."""
    found: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, sign, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not sign or not key:
            raise ValueError(f"line {number}: expected key = value")
        if key in found:
            raise ValueError(f"line {number}: {key!r} is given twice")
        found[key] = value
    return found


def parse_flags(args: list[str]) -> tuple[dict[str, str], list[str]]:
    """``--key value`` and ``--key=value`` flags, and the arguments that are left."""
    found, rest, at = {}, [], 0
    while at < len(args):
        if args[at].startswith("--"):
            key, sign, value = args[at][2:].partition("=")
            if not sign:
                at += 1
                if at == len(args):
                    raise ValueError(f"--{key} needs a value")
                value = args[at]
            found[key.replace("-", "_")] = value
        else:
            rest.append(args[at])
        at += 1
    return found, rest


def load(args: list[str], file_text: str = "") -> tuple[SpatialConfig, list[str]]:
    flags, rest = parse_flags(args)
    return SpatialConfig().updated(parse_file(file_text), "file").updated(flags, "flags"), rest
