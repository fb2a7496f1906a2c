"""Type names of the SQL dialect and what they are in Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass(frozen=True)
class SqlType:
    name: str
    spark: T.DataType
    low: int | None = None
    high: int | None = None

    def in_range(self, column: Column) -> Column | None:
        """A condition on non-null values, where the Spark type is wider than the SQL type."""
        if self.low is None:
            return None
        return (column >= self.low) & (column <= self.high)


_TYPES = [
    SqlType("INT", T.IntegerType()),
    SqlType("BIGINT", T.LongType()),
    SqlType("UINT", T.LongType(), 0, 2**32 - 1),
    SqlType("BIGUINT", T.DecimalType(20, 0), 0, 2**64 - 1),
    SqlType("FLOAT", T.FloatType()),
    SqlType("DOUBLE", T.DoubleType()),
    SqlType("BOOLEAN", T.BooleanType()),
    SqlType("TEXT", T.StringType()),
    SqlType("BLOB", T.BinaryType()),
]
TYPES = {t.name: t for t in _TYPES}
TYPES |= {"INTEGER": TYPES["INT"], "BOOL": TYPES["BOOLEAN"], "UNSIGNED INTEGER": TYPES["UINT"]}


def named(name: str) -> SqlType:
    found = TYPES.get(" ".join(name.upper().split()))
    if found is None:
        raise ValueError(f"no such type: {name}")
    return found
