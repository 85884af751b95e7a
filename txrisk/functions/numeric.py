"""Numeric Column helpers with Python's rounding semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp split constant for doubles


def _split(x: Column):
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    return hi, x - hi


def _is_attribute(c: Column) -> bool:
    """True for a bare column reference (cheap to repeat in an expression)."""
    try:
        jc = c._jc
        node = jc.node() if hasattr(jc, "node") else jc.expr()
        return node.getClass().getSimpleName() in ("UnresolvedAttribute", "AttributeReference")
    except Exception:  # noqa: BLE001 - other Column implementations
        return False


def py_round(x: Column, digits: int) -> Column:
    """``round(x, digits)`` as Python computes it on a float.

    Python rounds the exact binary value (ties to even). Spark's ``round`` and
    ``bround`` round the shortest decimal string instead, which differs when
    that string ends in 5. Here the product ``x * 10**digits`` is formed with
    its exact error term (Dekker's two-product), and a product that lands on
    a half is moved by the sign of that error. All of it stays a Catalyst
    expression.
    """
    x = x.cast("double")
    if digits == 0:
        return F.rint(x)
    m = float(10 ** digits)

    def body(v: Column) -> Column:
        p = v * F.lit(m)
        vh, vl = _split(v)
        mh, ml = _split(F.lit(m))
        err = ((vh * mh - p) + vh * ml + vl * mh) + vl * ml
        half = F.abs(p - F.floor(p)) == F.lit(0.5)
        rounded = (F.when(half & (err > 0), F.ceil(p).cast("double"))
                   .when(half & (err < 0), F.floor(p).cast("double"))
                   .otherwise(F.rint(p)))
        return rounded / F.lit(m)

    if _is_attribute(x):
        return body(x)
    # A compound input is bound once: it is not copied into each of the many
    # references the exact rounding needs (Catalyst would otherwise inline it,
    # e.g. when a filter on a derived column is pushed down).
    return F.transform(F.array(x), body)[0]


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den when den > 0 else default (ANSI-safe: never divides by zero)."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 on a zero or empty denominator (metric convention)."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def round_half_up_fast(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in plain double arithmetic (generated code,
    no BigDecimal). For rounding that only exists to compare engines; the
    oracle SQL applies the same formula."""
    m = float(10 ** digits)
    return F.floor(x * F.lit(m) + F.lit(0.5)) / F.lit(m)
