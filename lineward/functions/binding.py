"""Reuse of a computed value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it.

    Written as a transform of a one-element array, so the expression stays as small as it reads:
    without it every mention would be a copy, and copies of copies multiply.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def let_sql(value: str, name: str, body: str) -> str:
    """The same for an expression in SQL; ``body`` refers to the value by ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"
