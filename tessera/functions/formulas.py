"""Named formulas of one variable ``x`` (the reference registers custom
activation formulas by name).  A formula is a Spark SQL expression in
``x``; it applies to a numeric column or element-wise to an array column
through a SQL lambda - JVM-side, no Python evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_FORMULAS: dict[str, str] = {
    # Fixed value: the reference's documented example, clamp(x * 0.5 + 0.5, 0, 1).
    "clamp_half": "least(greatest(x * 0.5 + 0.5, 0), 1)",
}


def register_formula(name: str, expression: str) -> None:
    if "x" not in expression:
        raise ValueError("a formula must use the variable x")
    _FORMULAS[name] = expression


def formulas() -> dict[str, str]:
    return dict(_FORMULAS)


def apply_formula(name: str, column: str, elementwise: bool = False) -> Column:
    """``name`` applied to column ``column`` (element-wise for arrays)."""
    if name not in _FORMULAS:
        raise ValueError(f"unknown formula {name!r}")
    body = _FORMULAS[name]
    ref = "`" + column.replace("`", "``") + "`"
    if elementwise:
        return F.expr(f"transform({ref}, x -> {body})")
    return F.expr(f"get(transform(array({ref}), x -> {body}), 0)")


def register_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A function of the session that every expression may call by name
    (``add_column``, filters, ``spark.sql``): a SQL body over ``arguments``
    (``"price double, share double"``), inlined into the plan, so it costs what
    its body costs.  Registering a name again replaces it."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a function name: {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
