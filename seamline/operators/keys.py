"""Sequence keys of one or several columns, and parameters that are a number or a column that each sequence has one value of.

A sweep makes its setting a part of the sequence key and its parameters columns, so that one pass serves all settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Seq = str | list[str] | tuple[str, ...]
Param = float | str


def keys(seq: Seq) -> list[str]:
    return [seq] if isinstance(seq, str) else list(seq)


def value(param: Param) -> Column:
    """A parameter's column: the one of that name, or the number."""
    return F.col(param) if isinstance(param, str) else F.lit(float(param))


def columns_of(*params: Param) -> list[str]:
    """The parameters that are columns, each once."""
    return list(dict.fromkeys(p for p in params if isinstance(p, str)))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once for each row, though what follows uses them more than once. (A column
    of a plain select is worked out anew wherever it is used in the same stage.)"""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def with_settings(rows: DataFrame, settings: list[dict], schema: str) -> DataFrame:
    """rows once for each setting, with its parameters as columns: no scan and no join of their own."""
    if not settings:
        raise ValueError("a sweep needs a setting")
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    grid = [F.struct(*(F.lit(s.get(name)).cast(kind).alias(name) for name, kind in fields)) for s in settings]
    return rows.select(*rows.columns, F.inline(F.array(*grid)))
