"""Functions that scripts define, over real numbers.

A function without recursion becomes one Catalyst expression: its statements are executed symbolically, `si` turns into
`when`, and calls are inlined. Recursive functions run as a vectorised Arrow function.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumbre.errors import EngineError
from lumbre.plans.nodes import Assign, Binary, Call, Function, If, Name, Number, Return

MAX_DEPTH = 1000
FEW_ROWS = 8  # fewer are faster one by one
BLOCK = 2048  # rows that are called at once: each level of a recursion holds their variables
COMPARE = {"==", "!=", "<", "<=", ">", ">="}


def _arithmetic(op: str, x: float, y: float) -> float:
    if op == "/" and y == 0:
        raise EngineError("ARGUMENT", "division by zero")
    if op in COMPARE:
        return float({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
    try:
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[op]()
    except OverflowError as e:
        raise EngineError("OVERFLOW", op) from e
    if not math.isfinite(out):
        raise EngineError("OVERFLOW", f"{op} is not finite")
    return out


def _arithmetic_rows(op: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if op == "/" and not y.all():
        raise EngineError("ARGUMENT", "division by zero")
    if op in COMPARE:
        return {"==": np.equal, "!=": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[op](x, y).astype("float64")
    with np.errstate(all="ignore"):
        out = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}[op](x, y)
    if not np.isfinite(out).all():
        raise EngineError("OVERFLOW", f"{op} is not finite")
    return out


@dataclass
class Program:
    functions: dict[str, Function]

    def call(self, name: str, *arguments: float) -> float:
        """The value for given numbers; a function that doesn't return gives 0."""
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * MAX_DEPTH))
        return self._invoke(name, [float(a) for a in arguments], 0)

    def call_rows(self, name: str, *arguments: np.ndarray) -> np.ndarray:
        """call for many rows at once: a statement runs for the rows that reach it, a few rows one by one."""
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * MAX_DEPTH))
        return self._invoke_rows(name, list(arguments), len(arguments[0]), 0)

    def _invoke_rows(self, name: str, arguments: list[np.ndarray], n: int, depth: int) -> np.ndarray:
        if n < FEW_ROWS:
            return np.array([self._invoke(name, [float(a[i]) for a in arguments], depth) for i in range(n)], dtype="float64")
        if depth >= MAX_DEPTH:
            raise EngineError("LIMIT", "calls are nested too deep")
        f = self._function(name, len(arguments))
        out = np.zeros(n)
        self._run_rows(f.body, dict(zip(f.parameters, arguments)), np.arange(n), depth, out)
        return out

    def _run_rows(self, body: tuple, scope: dict[str, np.ndarray], rows: np.ndarray, depth: int, out: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Writes into out what rows return; the rows that don't, and their variables: a value per row, NaN where it has none."""
        for s in body:
            if not len(rows):
                break
            if isinstance(s, Return):
                out[rows] = self._value_rows(s.value, scope, len(rows), depth)
                rows, scope = rows[:0], {}
            elif isinstance(s, Assign):
                scope = {**scope, s.name: self._value_rows(s.value, scope, len(rows), depth)}
            elif isinstance(s, If):
                true = self._value_rows(s.condition, scope, len(rows), depth) != 0
                parts = [self._run_rows(b, {k: v[at] for k, v in scope.items()}, rows[at], depth, out) for b, at in ((s.then, true), (s.other, ~true)) if at.any()]
                rows = np.concatenate([r for r, _ in parts])
                left = [v for r, v in parts if len(r)]
                scope = {k: np.concatenate([v.get(k, np.full(len(r), math.nan)) for r, v in parts if len(r)]) for k in dict.fromkeys(k for v in left for k in v)}
        return rows, scope

    def _value_rows(self, e, scope: dict[str, np.ndarray], n: int, depth: int) -> np.ndarray:
        if isinstance(e, Number):
            return np.full(n, float(e.value))
        if isinstance(e, Name):
            if e.name not in scope or np.isnan(scope[e.name]).any():
                raise EngineError("DATA", f"unknown variable {e.name}")
            return scope[e.name]
        if isinstance(e, Binary):
            return _arithmetic_rows(e.op, self._value_rows(e.left, scope, n, depth), self._value_rows(e.right, scope, n, depth))
        return self._invoke_rows(e.name, [self._value_rows(a, scope, n, depth) for a in e.arguments], n, depth + 1)

    def _function(self, name: str, count: int) -> Function:
        f = self.functions.get(name)
        if f is None:
            raise EngineError("DATA", f"unknown function {name}")
        if len(f.parameters) != count:
            raise EngineError("ARGUMENT", f"{name} takes {len(f.parameters)} arguments")
        return f

    def _invoke(self, name: str, arguments: list[float], depth: int) -> float:
        if depth >= MAX_DEPTH:
            raise EngineError("LIMIT", "calls are nested too deep")
        f = self._function(name, len(arguments))
        scope = dict(zip(f.parameters, arguments))
        out = self._run(f.body, scope, depth)
        return 0.0 if out is None else out

    def _run(self, body: tuple, scope: dict[str, float], depth: int) -> float | None:
        for s in body:
            if isinstance(s, Return):
                return self._value(s.value, scope, depth)
            if isinstance(s, Assign):
                scope[s.name] = self._value(s.value, scope, depth)
            elif isinstance(s, If):
                out = self._run(s.then if self._value(s.condition, scope, depth) else s.other, scope, depth)
                if out is not None:
                    return out
        return None

    def _value(self, e, scope: dict[str, float], depth: int) -> float:
        if isinstance(e, Number):
            return e.value
        if isinstance(e, Name):
            if e.name not in scope:
                raise EngineError("DATA", f"unknown variable {e.name}")
            return scope[e.name]
        if isinstance(e, Binary):
            return _arithmetic(e.op, self._value(e.left, scope, depth), self._value(e.right, scope, depth))
        return self._invoke(e.name, [self._value(a, scope, depth) for a in e.arguments], depth + 1)

    def recursive(self, name: str) -> bool:
        """Whether a call of name can lead to a call of a function that is under way."""

        def calls(e) -> set[str]:
            if isinstance(e, Call):
                return {e.name}.union(*(calls(a) for a in e.arguments))
            if isinstance(e, Binary):
                return calls(e.left) | calls(e.right)
            if isinstance(e, (Return, Assign)):
                return calls(e.value)
            if isinstance(e, If):
                return calls(e.condition).union(*(calls(s) for s in (*e.then, *e.other)))
            return set()

        def walk(n: str, path: tuple[str, ...]) -> bool:
            if n in path:
                return True
            f = self.functions.get(n)
            return f is not None and any(walk(m, (*path, n)) for s in f.body for m in calls(s))

        return walk(name, ())

    def column(self, name: str) -> Callable[..., Column]:
        """The function over columns; a null argument gives null."""
        f = self.functions.get(name)
        if f is None:
            raise EngineError("DATA", f"unknown function {name}")
        if self.recursive(name):

            @F.pandas_udf("double")
            def run(*columns: pd.Series) -> pd.Series:
                given = [c.to_numpy(dtype="float64", na_value=math.nan) for c in columns]
                known = np.flatnonzero(~np.isnan(given).any(axis=0))
                out = np.full(len(columns[0]), math.nan)
                for at in range(0, len(known), BLOCK):
                    rows = known[at : at + BLOCK]
                    out[rows] = self.call_rows(name, *(a[rows] for a in given))
                return pd.Series(out)

            return lambda *a: run(*(x.cast("double") for x in a))

        def over(*arguments: Column) -> Column:
            given = [a.cast("double") for a in arguments]
            value = self._symbolic(name, given)
            for a in given:
                value = F.when(a.isNotNull(), value)
            return value

        return over

    def _symbolic(self, name: str, arguments: list[Column]) -> Column:
        f = self._function(name, len(arguments))
        return self._paths(f.body, dict(zip(f.parameters, arguments)), lambda scope: F.lit(0.0))

    def _paths(self, body: tuple, scope: dict[str, Column], rest: Callable[[dict[str, Column]], Column]) -> Column:
        """The value of a body that goes on with rest where it doesn't return."""
        if not body:
            return rest(scope)
        s, tail = body[0], body[1:]
        if isinstance(s, Return):
            return self._expression(s.value, scope)
        if isinstance(s, Assign):
            return self._paths(tail, {**scope, s.name: self._expression(s.value, scope)}, rest)
        after = lambda inner: self._paths(tail, inner, rest)
        condition = self._expression(s.condition, scope) != 0
        return F.when(condition, self._paths(s.then, scope, after)).otherwise(self._paths(s.other, scope, after))

    def _expression(self, e, scope: dict[str, Column]) -> Column:
        if isinstance(e, Number):
            return F.lit(e.value)
        if isinstance(e, Name):
            if e.name not in scope:
                raise EngineError("DATA", f"unknown variable {e.name}")
            return scope[e.name]
        if isinstance(e, Call):
            return self._symbolic(e.name, [self._expression(a, scope) for a in e.arguments])
        x, y = self._expression(e.left, scope), self._expression(e.right, scope)
        if e.op in COMPARE:
            return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op].cast("double")
        if e.op == "/":
            y = F.when(y == 0, F.raise_error(F.lit("ARGUMENT: division by zero"))).otherwise(y)
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[e.op]()
        return F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.raise_error(F.lit("OVERFLOW: not finite"))).otherwise(out)
