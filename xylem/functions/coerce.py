"""XPath's conversions between strings, numbers and booleans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def text_to_number(s: Column) -> Column:
    """A double; what is no plain number (blanks around it, too) is NaN. Accepts signs, exponents, inf and nan."""
    plain = s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    low = F.lower(s)
    return (
        F.when(s.isNull(), F.lit(NAN)).when(plain, s.try_cast("double"))
        .when(low.rlike(r"^\+?inf(?:inity)?$"), F.lit(INF)).when(low.rlike(r"^-inf(?:inity)?$"), F.lit(-INF)).otherwise(F.lit(NAN))
    )


def number_to_text(x: Column) -> Column:
    """The shortest decimal form, without an exponent: ``1``, ``39.95``, ``0.0000001``, ``NaN``, ``inf``."""
    shown = x.cast("string")
    mantissa, power = F.regexp_extract(shown, r"^-?([0-9.]+)E", 1), F.regexp_extract(shown, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    digits = F.regexp_replace(digits, r"(?<=.)0+$", "")
    point = power + 1  # digits before the point
    wide = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).otherwise(
        F.when(F.length(digits) <= point, F.rpad(digits, point, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(400))))
    )
    sign = F.when(F.startswith(shown, F.lit("-")), "-").otherwise("")
    return (
        F.when(F.isnan(x), "NaN").when(x == INF, "inf").when(x == -INF, "-inf")
        .when(F.contains(shown, F.lit("E")), F.concat(sign, wide)).otherwise(F.regexp_replace(shown, r"\.0$", ""))
    )


def to_number(c: Column, kind: str) -> Column:
    return c if kind == "num" else F.when(c, 1.0).otherwise(0.0) if kind == "bool" else text_to_number(c)


def to_text(c: Column, kind: str) -> Column:
    return number_to_text(c) if kind == "num" else F.when(c, "true").otherwise("false") if kind == "bool" else F.coalesce(c, F.lit(""))


def to_bool(c: Column, kind: str) -> Column:
    return c if kind == "bool" else ((c != 0) & ~F.isnan(c)) if kind == "num" else F.coalesce(F.length(c) > 0, F.lit(False))


def compare(op: str, a: Column, b: Column) -> Column:
    """An order of numbers in which NaN is in no relation."""
    out = a < b if op == "<" else a <= b if op == "<=" else a > b if op == ">" else a >= b
    return ~F.isnan(a) & ~F.isnan(b) & out


def divide(a: Column, b: Column) -> Column:
    """Division as floating-point hardware does it."""
    negative = (a < 0) != F.startswith(b.cast("string"), F.lit("-"))
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(NAN)).when(negative, F.lit(-INF)).otherwise(F.lit(INF))


def remainder(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; NaN for a divisor of 0."""
    return F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b))


def whole(c: Column, how: str) -> Column:
    """floor, ceil or round (half away from zero), as a double; infinities and NaN stay."""
    odd = F.isnan(c) | (F.abs(c) >= 2.0**52)
    size = F.abs(c)
    if how == "round":
        up = F.floor(size).cast("double") + F.when(size - F.floor(size) >= 0.5, 1.0).otherwise(0.0)
        done = F.when(c < 0, -up).otherwise(up)
    else:
        done = (F.floor(c) if how == "floor" else F.ceil(c)).cast("double")
    return F.when(odd, c).otherwise(done)
