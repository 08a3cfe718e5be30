"""Column-spec graphs: checks and order of derivation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Spec:
    name: str
    needs: tuple[str, ...] = ()
    build: Callable[[], Column] | None = None


def ordered(specs: list[Spec], given: tuple[str, ...] = ()) -> list[list[Spec]]:
    """Layers of specs whose needs earlier layers (or the given columns) meet; duplicates, unknown needs and cycles raise."""
    names = [s.name for s in specs]
    if twice := {n for n in names if names.count(n) > 1 or n in given}:
        raise ValueError(f"defined more than once: {sorted(twice)}")
    if unknown := {n for s in specs for n in s.needs} - set(names) - set(given):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    known, left, layers = set(given), list(specs), []
    while left:
        ready = [s for s in left if set(s.needs) <= known]
        if not ready:
            raise ValueError(f"cycle among: {sorted(s.name for s in left)}")
        layers.append(ready)
        known |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return layers


def derive(rows: DataFrame, specs: list[Spec]) -> DataFrame:
    """One projection for each layer."""
    for layer in ordered(specs, tuple(rows.columns)):
        rows = rows.withColumns({s.name: s.build() for s in layer})
    return rows
