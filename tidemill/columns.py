"""Column references that are safe for any header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Reference a column by its exact name (dots and spaces included)."""
    return F.col(quoted(name))
