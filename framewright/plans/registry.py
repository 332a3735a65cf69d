"""Operators by name: what each takes, needs and makes, checked before it runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple)}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str = "string"
    description: str = ""
    default: Any = None
    required: bool = False
    choices: tuple = ()

    def schema(self) -> dict:
        out: dict[str, Any] = {"type": self.kind, "description": self.description}
        if self.choices:
            out["enum"] = list(self.choices)
        if self.default is not None:
            out["default"] = self.default
        return out

    def check(self, value: Any) -> Any:
        if value is None:
            if self.required:
                raise ValueError(f"parameter {self.name} is required")
            return self.default
        right = isinstance(value, _KINDS[self.kind]) and not (self.kind in ("integer", "number") and isinstance(value, bool))
        if not right or (self.choices and value not in self.choices):
            raise ValueError(f"parameter {self.name}: {value!r} is no {self.kind}" + (f" of {self.choices}" if self.choices else ""))
        return value


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., dict[str, Any]]
    description: str = ""
    category: str = "general"
    parameters: tuple[Parameter, ...] = ()
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()

    def schema(self) -> dict:
        return {"name": self.name, "description": self.description, "input_schema": {"type": "object", "properties": {p.name: p.schema() for p in self.parameters}, "required": [p.name for p in self.parameters if p.required]}}


@dataclass
class Session:
    """Named results of one analysis. DataFrames are also temporary views, so that SQL sees them."""

    spark: SparkSession
    values: dict[str, Any] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def put(self, name: str, value: Any) -> None:
        self.values[name] = value
        if isinstance(value, DataFrame):
            value.createOrReplaceTempView(name)


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Operator] = {}

    def add(self, operator: Operator) -> Operator:
        if operator.name in self.known:
            raise ValueError(f"{operator.name} is there already")
        self.known[operator.name] = operator
        return operator

    def operator(self, name: str, description: str = "", parameters: tuple[Parameter, ...] = (), requires: tuple[str, ...] = (), produces: tuple[str, ...] = (), category: str = "general"):
        """Decorator: a function (session, **parameters) -> results by name becomes an operator."""

        def wrap(f):
            self.add(Operator(name, f, description or (f.__doc__ or "").strip(), category, tuple(parameters), tuple(requires), tuple(produces)))
            return f

        return wrap

    def available(self, session: Session) -> list[str]:
        return sorted(n for n, o in self.known.items() if all(r in session.values for r in o.requires))

    def definitions(self) -> str:
        return json.dumps([o.schema() for _, o in sorted(self.known.items())])

    def call(self, session: Session, name: str, **parameters: Any) -> dict[str, Any]:
        """Check prerequisites and parameters, run, keep what it makes, and log the call."""
        op = self.known[name]
        missing = [r for r in op.requires if r not in session.values]
        if missing:
            raise ValueError(f"{name} needs {missing}")
        unknown = set(parameters) - {p.name for p in op.parameters}
        if unknown:
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
        args = {p.name: p.check(parameters.get(p.name)) for p in op.parameters}
        made = op.run(session, **args)
        for k, v in made.items():
            session.put(k, v)
        session.log.append({"operator": name, "parameters": {k: v for k, v in args.items() if isinstance(v, (str, int, float, bool, type(None)))}, "produced": sorted(made)})
        return made
