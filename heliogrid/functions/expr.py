"""Small helpers to write expressions that Spark SQL and DuckDB read alike.

Formulas are functions from operand texts to an expression text.  ``column`` turns one
into a Column; the SQL oracles use the same text, so both engines evaluate one formula.
Numbers are written with an exponent, as both engines read those as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> str:
    """A double literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def column(text: str) -> Column:
    return F.expr(text)


def wrap(x: str, period: float) -> str:
    """x reduced to [0, period)."""
    return f"(({x}) - {num(period)} * CAST(floor(({x}) / {num(period)}) AS DOUBLE))"


def clip(x: str, lo: float | None, hi: float | None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {num(lo)})"
    if hi is not None:
        out = f"least({out}, {num(hi)})"
    return out


def ratio(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"(({a}) / nullif({b}, 0e0))"


def horner(x: str, coefficients: list[float | str]) -> str:
    """A polynomial in x, coefficients from the constant upwards."""
    texts = [c if isinstance(c, str) else num(c) for c in coefficients]
    out = texts[-1]
    for c in reversed(texts[:-1]):
        out = f"({c} + {x} * {out})"
    return out


def rad(x: str) -> str:
    return f"(({x}) * (pi() / 180e0))"


def case(*branches: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in branches) + f" ELSE {other} END"
