"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once even where use's lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def free_prefix(names: Iterable[str]) -> str:
    """A prefix that none of the names begins with, in any letter case."""
    prefix, taken = "__", [n.lower() for n in names]
    while any(n.startswith(prefix) for n in taken):
        prefix += "_"
    return prefix
