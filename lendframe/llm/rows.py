"""Carrying a caller's columns past an operator's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(columns: list[str]) -> Column:
    """The columns as one struct, in which no name can meet one of the operator's."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def unpack(struct: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{struct}.c{i}").alias(c) for i, c in enumerate(columns)]


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
