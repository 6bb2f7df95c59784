"""Named operators: DataFrame in, DataFrame out, with parameters that carry a schema."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

_KINDS = {"float": "number", "int": "integer", "str": "string", "bool": "boolean", "list": "array", "dict": "object"}


@dataclass(frozen=True)
class Operator:
    name: str
    group: str
    function: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    doc: str = ""
    params: dict[str, dict[str, Any]] = field(default_factory=dict)

    def schema(self) -> dict[str, Any]:
        """JSON Schema of the parameters."""
        needed = [k for k, v in self.params.items() if "default" not in v]
        return {"type": "object", "properties": self.params, "required": needed, "additionalProperties": False}


class Registry:
    """Operators by name; a name registered again is an error."""

    def __init__(self):
        self._by_name: dict[str, Operator] = {}

    def register(self, group: str, name: str | None = None) -> Callable:
        """Decorator.  Arguments annotated DataFrame or without annotation are inputs, the others parameters."""

        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            key = name or f.__name__
            if key in self._by_name:
                raise ValueError(f"operator {key} is registered already")
            inputs, params = [], {}
            for p in inspect.signature(f).parameters.values():
                kind = str(p.annotation)
                if "DataFrame" in kind or p.annotation is inspect.Parameter.empty:
                    inputs.append(p.name)
                    continue
                word = getattr(p.annotation, "__name__", kind).split("[")[0]
                params[p.name] = {"type": _KINDS.get(word.split(" | ")[0], "string")}
                if p.default is not inspect.Parameter.empty:
                    params[p.name]["default"] = p.default
            self._by_name[key] = Operator(key, group, f, tuple(inputs), inspect.getdoc(f) or "", params)
            return f

        return wrap

    def get(self, name: str) -> Operator:
        if name not in self._by_name:
            raise KeyError(f"no operator {name}; there are {', '.join(sorted(self._by_name))}")
        return self._by_name[name]

    def dispatch(self, name: str, *inputs: DataFrame, **params: Any) -> DataFrame:
        """Run an operator, its parameters checked by name."""
        op = self.get(name)
        if unknown := set(params) - set(op.params):
            raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        return op.function(*inputs, **params)

    def names(self, group: str | None = None) -> list[str]:
        return sorted(k for k, v in self._by_name.items() if group in (None, v.group))

    def groups(self) -> dict[str, list[str]]:
        return {g: self.names(g) for g in sorted({o.group for o in self._by_name.values()})}

    def schemas(self) -> str:
        """All operators with descriptions and parameter schemas, as JSON."""
        return json.dumps([{"name": o.name, "group": o.group, "description": o.doc, "inputs": list(o.inputs), "parameters": o.schema()} for o in sorted(self._by_name.values(), key=lambda o: o.name)], default=str, ensure_ascii=False)


registry = Registry()
operator = registry.register
