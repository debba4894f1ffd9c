"""Naming a value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, where it would occur many times in the expression and make it explode."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: dict[str, object]) -> Column:
    """The table's value for a key, null for other keys; the key is computed once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
