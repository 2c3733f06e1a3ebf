"""Date parsing with the formats the analysis is configured with.

Configuration states formats in C/strptime style (``%Y%m%d``); Spark's
datetime functions use pattern letters (``yyyyMMdd``).  ``spark_pattern``
translates, and ``parse_date`` parses a string column with the built-in
``try_to_date`` / ``to_date`` (no Python UDF, so whole-stage codegen keeps
the expression).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives and their Spark pattern letters.
STRPTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%%": "%",
}


def spark_pattern(fmt: str) -> str:
    """``%Y-%m-%d`` -> ``yyyy-MM-dd``; Spark patterns pass through unchanged.
    Literal letters are quoted so Spark does not read them as fields."""
    if "%" not in fmt:
        return fmt
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in STRPTIME_TO_SPARK:
            out.append(STRPTIME_TO_SPARK[tok])
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


def parse_date(col: Column | str, fmt: str = "yyyyMMdd", strict: bool = False) -> Column:
    """String -> DATE with ``fmt``.  Lenient by default: an unparsable value
    becomes null (the loaders count such rows as malformed).  ``strict``
    raises on bad input, like ``strptime``.  Null stays null either way."""
    c = F.col(col) if isinstance(col, str) else col
    pattern = spark_pattern(fmt)
    return F.to_date(c, pattern) if strict else F.try_to_date(c, pattern)
