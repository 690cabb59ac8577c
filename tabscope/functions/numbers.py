"""Numbers in text, read as pandas reads them (no Java type suffixes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^[+-]?[0-9]+$"
_DOUBLE = r"^[+-]?(?i:[0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)$|^(?i:nan)$"


def numeric_text(v: Column, target: str = "double") -> Column:
    """``v`` (trimmed text) as ``target``; NULL where it is no plain number.

    ``1d`` and ``2F`` are text; ``inf`` and values beyond the range of a double are
    infinite, as in pandas."""
    return F.when(v.rlike(_INT if target != "double" else _DOUBLE), v.try_cast(target))
