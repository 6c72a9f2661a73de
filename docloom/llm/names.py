"""Names of working columns that clash with no column of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores added as it takes to be no column of df, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def rest(df: DataFrame, *results: str) -> list[str]:
    """The columns of df without those that results of these names replace."""
    return [c for c in df.columns if c.lower() not in {r.lower() for r in results}]
