"""Rounding as Python's round() does it: of the exact binary value, ties to the even digit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value evaluated once however often `of` uses it."""
    return F.transform(F.array(value), of)[0]


def round_even(x: Column, places: int) -> Column:
    """x to at most seven places.  Neither engine's own round() looks at the exact value (29.37515 lies below its decimal form), so what the
    product with 10 ** places loses is found by splitting x in two halves, and decides where the product itself is a tie."""
    if not 0 <= places <= 7:
        raise ValueError("0 to 7 places")
    scale = F.lit(float(10**places))

    def of(v: Column) -> Column:
        a = F.abs(v)
        p = a * scale
        high = a * 134217729.0 - (a * 134217729.0 - a)
        lost = (high * scale - p) + (a - high) * scale
        whole = F.floor(p).cast("double")
        rest = p - whole - 0.5
        up = (rest > 0) | ((rest == 0) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
        return F.signum(v) * (whole + F.when(up, 1.0).otherwise(0.0)) / scale

    return let(x.cast("double"), of)


def round_scaled(x: Column, places: int) -> Column:
    """x to some places as SQL engines do it: the rounded product with 10 ** places, ties away from zero, over that power (Spark's own round looks at the decimal form)."""
    scale = float(10**places)
    return F.round(x.cast("double") * scale, 0) / scale


def round_even_sql(x: str, places: int) -> str:
    """The same in SQL, for an expression without side effects."""
    scale, a = f"CAST({10**places} AS DOUBLE)", f"abs(CAST({x} AS DOUBLE))"
    p, big = f"({a} * {scale})", f"({a} * CAST(134217729 AS DOUBLE))"
    high, whole = f"({big} - ({big} - {a}))", f"floor({a} * {scale})"
    lost, rest = f"(({high} * {scale} - {p}) + ({a} - {high}) * {scale})", f"({p} - {whole} - CAST(0.5 AS DOUBLE))"
    return f"(sign(CAST({x} AS DOUBLE)) * ({whole} + CASE WHEN {rest} > 0 OR {rest} = 0 AND ({lost} > 0 OR {lost} = 0 AND {whole} % 2 = 1) THEN 1 ELSE 0 END) / {scale})"
