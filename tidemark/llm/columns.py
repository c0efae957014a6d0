"""Column names and schemas beside whatever columns a table brings along."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores put before it until no column of df is called so, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(schema: StructType, more: str) -> StructType:
    """schema with further fields, given as DDL. Built of fields and not of text, so that names of any kind come through."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema] + StructType.fromDDL(more).fields)


def quoted(name: str) -> str:
    """A column's name as select() takes it literally, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def plain(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with other names for columns whose names need quoting, which functions over Arrow batches don't take, and what gives a result their own names back."""
    others = [c for c in df.columns if not re.fullmatch(r"\w+", c)]
    if not others:
        return df, lambda out: out
    named = dict(zip(others, spare(df, *(f"_c{i}" for i in range(len(others)))), strict=True))
    back = {v: k for k, v in named.items()}
    return df.toDF(*[named.get(c, c) for c in df.columns]), lambda out: out.toDF(*[back.get(c, c) for c in out.columns])
