"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / F.lit(f)


def micro(x: Column) -> Column:
    """Millionths as a whole number, so that sums don't depend on their order."""
    return F.floor(x * 1e6 + 0.5).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """num / den; null, not 0, for an empty denominator."""
    return F.when(den != 0, num / den)


def saturating(value: Column, saturation: Column) -> Column:
    """0 to 100, in proportion up to the saturation."""
    return F.least(F.greatest(value / saturation, F.lit(0.0)), F.lit(1.0)) * 100


def bounded_log(value: Column, scale: Column) -> Column:
    """0 to 100 for counts: half-way where log1p(value / scale) is 1."""
    b = F.log1p(F.greatest(value, F.lit(0.0)) / scale)
    return 100 * b / (1 + b)


def glob_regex(glob: str) -> str:
    """Java regex of a path glob: ``**`` spans segments, ``*`` and ``?`` stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in "\\^$.|+()[]{}" else glob[i]), i + 1
    return f"^{out}$"


def package_name(specifier: Column) -> Column:
    """The package of a bare module specifier, with its scope if it has one."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)
