"""Number semantics shared by every table (see SURVEY §1.5)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the white space that is stripped from text before it is read as
# a number and that the part-number rule deletes (wider than Java's \\s).
WHITE_SPACE = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def to_fixed(x: Column, places: int) -> Column:
    """Round the exact binary value, halves away from zero.

    ``round`` works on the shortest decimal text, so 2.675 would go up although
    the stored double lies below the half.  Exact halves are the only case the
    formatter treats differently (half-even), and they are short binary
    fractions, on which ``round`` is exact.
    """
    pattern = "0" if places == 0 else "0." + "0" * places
    scaled = x * F.lit(float(2 ** (places + 2)))
    formatted = F.call_function("format_number", x, F.lit(pattern)).try_cast("double")
    return F.when(scaled % F.lit(1.0) == 0.0, F.round(x, places)).otherwise(formatted) + F.lit(0.0)


def text_number(text: Column) -> Column:
    """Text to double: blank is 0, anything that is not a number is NaN, NULL stays NULL."""
    t = strip(text)
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(t == "", F.lit(0.0))
        .when(t.rlike(_NUMERIC), t.try_cast("double"))
        .otherwise(F.lit(float("nan")))
    )


def number(df, name: str) -> Column:
    """Column ``name`` as a double, whatever type it was stored with."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    if df.schema[name].dataType.typeName() == "string":
        return text_number(F.col(name))
    return F.col(name).cast("double")


def number_or(x: Column, default: Column) -> Column:
    """``x`` unless it is missing, not a number or zero."""
    return F.coalesce(F.nullif(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), default)


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def exact_sum(x: Column) -> Column:
    """Sum of prices that does not depend on the order of the rows: added up as decimals."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")
