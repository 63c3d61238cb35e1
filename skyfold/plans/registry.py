"""The feature registry: whatever makes a column declares, beside its code, the family that the column belongs to.

A declared name may hold numbers (horizons, say); any other numbers in the same places are the same declaration.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"[0-9]+"
_FAMILY: dict[str, str] = {}


def _shape(name: str) -> str:
    return re.sub(_NUMBER, "#", name)


def declare(family: str, names: Iterable[str]) -> None:
    """Raises if another family has one of the names."""
    for name in names:
        if _FAMILY.setdefault(_shape(name), family) != family:
            raise ValueError(f"{name} belongs to {_FAMILY[_shape(name)]}, not to {family}")


def makes(family: str, *names: str) -> Callable:
    """For the operator that makes the columns."""

    def keep(operator):
        declare(family, names)
        return operator

    return keep


def families() -> list[str]:
    return list(dict.fromkeys(_FAMILY.values()))


def is_declared(name: str) -> bool:
    return _shape(name) in _FAMILY


def declared(spark: SparkSession) -> DataFrame:
    """(shape, family) of every declaration."""
    return spark.createDataFrame(list(_FAMILY.items()), "shape string, family string")


def with_family(columns: DataFrame, name: str | Column = "column") -> DataFrame:
    """The table of column names with their family, null where none is declared."""
    c = F.col(name) if isinstance(name, str) else name
    d = declared(columns.sparkSession).withColumnRenamed("shape", "_shape")
    return columns.join(d, F.regexp_replace(c, _NUMBER, "#") == F.col("_shape"), "left").drop("_shape")


def leaving_out(columns: Iterable[str], *dropped: str) -> list[str]:
    """The columns without those of the dropped families.  Undeclared ones stay; a family that nobody declares raises."""
    known = {f: {s for s, own in _FAMILY.items() if own == f} for f in families()}
    out = set().union(*(known[f] for f in dropped))
    return [c for c in columns if _shape(c) not in out]
