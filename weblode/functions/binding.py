"""Compose expressions as Spark SQL text and apply them to columns.

A column built call by call in Python costs a round trip to the JVM per operator, and using a column
twice copies its tree.  The larger expressions here are therefore SQL text: parsed once by Spark, with
intermediates named by one-element ``transform`` lambdas so each is evaluated once per row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def bind(value: str, body: Callable[[str], str]) -> str:
    """SQL for ``body(value)`` with ``value`` evaluated once."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def apply(body: Callable[[str], str], value: Column) -> Column:
    """Apply SQL text to a column, which may be a lambda variable."""
    name = f"v{next(_names)}"
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {body(name)}"))[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` over columns, with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def quoted(values: list[str]) -> str:
    """A list of string literals for ``IN``."""
    return "(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"
