"""Alias and pattern files, and where outputs go by default."""

from __future__ import annotations

from dataclasses import dataclass, field

from odonymy.paths import beside, name_of, read_text, stem_of
from odonymy.sources.osm import SUFFIXES


class AliasError(ValueError):
    pass


class PatternError(ValueError):
    pass


def _lines(path: object) -> list[tuple[int, str, str]]:
    """(number, trimmed, raw) of lines that are neither blank nor comments."""
    every = read_text(path).splitlines()
    return [(i, raw.strip(), raw) for i, raw in enumerate(every, 1) if raw.strip() and not raw.strip().startswith("#")]


def parse_aliases(path: object) -> dict[str, str]:
    """variant -> canonical of lines ``variant=canonical``; later ``=`` belong to the canonical key.

    A key mapped to itself is no mapping. A line without ``=``, an empty side, or a variant given
    twice is an error that names the line.
    """
    out: dict[str, str] = {}
    for number, line, raw in _lines(path):
        variant, sign, canonical = (part.strip() for part in line.partition("="))
        if not (variant and sign and canonical):
            raise AliasError(f"{path}:{number}: not of the form variant=canonical: {raw!r}")
        if variant == canonical:
            continue
        if variant in out:
            raise AliasError(f"{path}:{number}: {variant!r} has been mapped to {out[variant]!r} before")
        out[variant] = canonical
    return out


def check_aliases(mapping: dict[str, str]) -> None:
    """Rejects chains: a canonical key must not be a variant."""
    both = sorted(c for c in mapping.values() if c in mapping)
    if both:
        raise AliasError(f"canonical keys that are variants too: {', '.join(both)}")


@dataclass(frozen=True)
class Patterns:
    includes: list[str]
    excludes: list[str] = field(default_factory=list)


def parse_patterns(path: object) -> Patterns:
    """LIKE patterns, one a line; after a leading ``-`` (blanks may follow) a name must not match."""
    includes, excludes = [], []
    for _, line, _ in _lines(path):
        if not line.startswith("-"):
            includes.append(line)
        elif line[1:].strip():
            excludes.append(line[1:].strip())
    if not includes:
        raise PatternError(f"{path}: no pattern to include")
    return Patterns(includes, excludes)


def store_path(dump: object) -> str:
    """The dump's name without its suffix (as written), with .db; a folder."""
    name = name_of(dump)
    base = next((name[: -len(s)] for s in SUFFIXES if name.endswith(s)), stem_of(dump))
    return beside(dump, f"{base}.db")


def alias_path(store: object) -> str:
    return beside(store, "aliases.txt")


def map_path(store: object, target: str) -> str:
    return beside(store, f"{stem_of(store)}-{target}.png")


def cities_path(store: object) -> str:
    return beside(store, f"{stem_of(store)}-cities.csv")


def cities_map_path(store: object, patterns: object) -> str:
    return beside(store, f"{stem_of(store)}-{stem_of(patterns)}.png")


def kpi_path(store: object) -> str:
    return beside(store, f"{stem_of(store)}-kpi.csv")
