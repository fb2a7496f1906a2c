"""Scalar functions by their SQL name, with standard NULL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_D = "double"
#: Unicode white space.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SCALARS = {
    "LENGTH": lambda x: F.length(x).cast("bigint"),
    "CHAR_LENGTH": lambda x: F.length(x).cast("bigint"),
    "UPPER": F.upper,
    "LOWER": F.lower,
    "LTRIM": lambda x: F.regexp_replace(x, f"^{SPACE}+", ""),
    "RTRIM": lambda x: F.regexp_replace(x, f"{SPACE}+\\z", ""),
    "TRIM": lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+\\z", ""),
    "CONCAT": F.concat,
    "ABS": lambda x: F.abs(x).cast(_D),
    "ROUND": lambda x: F.round(x, 0).cast(_D),
    "CEIL": lambda x: F.ceil(x).cast(_D),
    "CEILING": lambda x: F.ceil(x).cast(_D),
    "FLOOR": lambda x: F.floor(x).cast(_D),
    "SQRT": lambda x: F.sqrt(x).cast(_D),
    "COALESCE": F.coalesce,
    "NULLIF": F.nullif,
    "INT_DIV": lambda a, b: F.call_function("div", a, b),
    "TRY_DIVIDE": F.try_divide,
    "ILIKE": lambda x, p: F.ilike(x, F.lit(p)) if isinstance(p, str) else F.ilike(x, p),
    "CONTAINS": F.contains,
    "STARTS_WITH": F.startswith,
    "ENDS_WITH": F.endswith,
}


def call(name: str, *args) -> Column:
    """The function of that name, of columns, column names or F.lit values."""
    known = SCALARS.get(name.upper())
    if known is None:
        raise ValueError(f"no such function: {name}")
    return known(*(F.col(a) if isinstance(a, str) and name.upper() != "ILIKE" else a for a in args))
