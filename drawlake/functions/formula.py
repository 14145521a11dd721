"""Arithmetic formulas over columns, compiled to Column expressions (never passed to SQL as text)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import numeric as N

_TOKENS = re.compile(r"\s*(?:(\d+\.?\d*(?:E[+-]?\d+)?|\.\d+(?:E[+-]?\d+)?)|([A-Za-z]\w*)|(.))")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Sinh": F.sinh, "Cosh": F.cosh, "Tanh": F.tanh, "Exp": F.exp, "Log": F.log, "Sqrt": F.sqrt, "Abs": F.abs,
    "Sign": N.sign, "Theta": N.theta, "Delta": N.delta, "Frac": N.frac, "LGamma": N.lgamma, "LogSumExp": N.log_sum_exp,
    "Normal": N.normal_energy, "Gaussian": N.normal_energy, "ExpGamma": N.exp_gamma_energy, "ExpGamma2": N.exp_gamma2_energy, "Bernoulli": N.bernoulli_energy,
}
_DENSITIES = {"Normal", "Gaussian", "ExpGamma", "ExpGamma2", "Bernoulli"}


def register(name: str, function: Callable[..., Column]) -> None:
    """Make a column function (a pandas UDF, say) callable from formulas."""
    FUNCTIONS[name] = function


class _Reader:
    """One pass over the tokens, building the column bottom-up by precedence."""

    def __init__(self, text: str, columns: dict[str, Column]):
        self.items = [m.groups() for m in _TOKENS.finditer(text.strip())]
        self.at, self.columns = 0, columns

    def peek(self) -> str | None:
        return next((x for x in self.items[self.at] if x), None) if self.at < len(self.items) else None

    def take(self, wanted: str | None = None) -> str:
        found = self.peek()
        if found is None or wanted and found != wanted:
            raise ValueError(f"formula: expected {wanted or 'more'}, found {found or 'the end'}")
        self.at += 1
        return found

    def total(self) -> Column:
        minus = self.peek() == "-"
        if self.peek() in ("+", "-"):
            self.take()
        out = -self.product() if minus else self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out - self.product()
        if self.peek() == "~":
            self.take()
            name = self.take()
            if name not in _DENSITIES:
                raise ValueError(f"formula: {name} is no distribution")
            out = FUNCTIONS[name](out, *self.arguments())
        return out

    def product(self) -> Column:
        out = self.power()
        while (p := self.peek()) and (p in "*/" or p in _CLOSE or p[0].isalnum() or p[0] == "."):
            if p == "/":
                self.take()
                out = out / self.power()
            else:
                if p == "*":
                    self.take()
                out = N.times(out, self.power())
        return out

    def power(self) -> Column:
        out = self.atom()
        if self.peek() == "^":
            self.take()
            minus = self.peek() == "-" and bool(self.take())
            n = int(self.take()) * (-1 if minus else 1)
            out = F.pow(out, F.lit(float(n)))
        return out

    def arguments(self) -> list[Column]:
        close = _CLOSE[self.take()]
        out = [self.total()]
        while self.peek() == ",":
            self.take()
            out.append(self.total())
        self.take(close)
        return out

    def atom(self) -> Column:
        p = self.peek()
        if p in _CLOSE:
            inside = self.arguments()
            if len(inside) != 1:
                raise ValueError("formula: a list stands where a value should")
            return inside[0]
        self.take()
        if p is not None and (p[0].isdigit() or p[0] == "."):
            return F.lit(float(p))
        if p == "Pi":
            return F.lit(math.pi)
        if p in FUNCTIONS:
            return FUNCTIONS[p](*self.arguments())
        if p in self.columns:
            return self.columns[p]
        raise ValueError(f"formula: unknown name {p}")


def formula(text: str, df: DataFrame | None = None, names: dict[str, Column] | None = None) -> Column:
    """The column of a formula over the columns of ``df`` and the extra ``names``."""
    columns = {c: F.col(c).cast("double") for c in (df.columns if df is not None else [])} | (names or {})
    reader = _Reader(text, columns)
    out = reader.total()
    if reader.peek() is not None:
        raise ValueError(f"formula: {reader.peek()} is left over")
    return out


def with_definitions(df: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """Columns defined one after the other, later ones may use earlier ones."""
    for name, text in definitions.items():
        df = df.withColumn(name, formula(text, df))
    return df
