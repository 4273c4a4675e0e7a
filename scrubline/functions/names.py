"""Names of work columns that clash with none of a caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """A name for each base that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"_{base}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns of df but those of the given names, which a result replaces."""
    gone = {c.lower() for c in replaced}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
