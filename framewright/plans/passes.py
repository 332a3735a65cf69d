"""Many measurements, one pass: named aggregates that are planned into as few scans as can be."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Metric:
    """Aggregates over the rows of one frame, for those a predicate selects."""

    name: str
    columns: Callable[[Callable[[str], Column]], dict[str, Column]]
    default: bool = False


@dataclass
class Metrics:
    """A registry of per-frame metrics; ``run`` computes any number of them in one aggregation."""

    known: dict[str, Metric] = field(default_factory=dict)

    def register(self, name: str, columns: Callable, default: bool = False) -> None:
        self.known[name] = Metric(name, columns, default)

    def names(self) -> list[str]:
        return sorted(self.known)

    def defaults(self) -> list[str]:
        return sorted(n for n, m in self.known.items() if m.default)

    def run(self, atoms: DataFrame, metrics: Sequence[str] | None = None, selections: dict[str, Column] | None = None, by: Sequence[str] = ("traj_id", "frame"), frames: tuple[int | None, int | None, int] = (None, None, 1)) -> DataFrame:
        """One row per frame with the columns of all metrics. frames is start, stop and step; the filter reaches the scan."""
        start, stop, step = frames
        some = atoms
        if start is not None:
            some = some.where(F.col("frame") >= start)
        if stop is not None:
            some = some.where(F.col("frame") < stop)
        if step > 1:
            some = some.where(F.pmod(F.col("frame") - (start or 0), F.lit(step)) == 0)
        out: dict[str, Column] = {}
        for name in metrics or self.defaults():
            picked = (selections or {}).get(name)
            value = (lambda p: lambda c: F.col(c) if p is None else F.when(p, F.col(c)))(picked)
            out |= self.known[name].columns(value)
        return some.groupBy(*by).agg(*(c.alias(n) for n, c in out.items()))


def _gyration(v) -> dict[str, Column]:
    return {"rg": F.sqrt(F.var_pop(v("x")) + F.var_pop(v("y")) + F.var_pop(v("z")))}


def standard() -> Metrics:
    """Metrics that need nothing but sums: centroid, gyration radius, extent and number of atoms."""
    m = Metrics()
    m.register("rg", _gyration, True)
    m.register("centroid", lambda v: {f"c{a}": F.avg(v(a)) for a in "xyz"}, True)
    m.register("extent", lambda v: {f"span_{a}": F.max(v(a)) - F.min(v(a)) for a in "xyz"})
    m.register("atoms", lambda v: {"n_atoms": F.count(v("atom_id"))})
    return m
