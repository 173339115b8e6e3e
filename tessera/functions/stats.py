"""Column expressions of the statistics; all are built-ins, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-12


def strip(text: Column) -> Column:
    """Without white space at either end (Unicode white space, null: empty)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def variance(n: Column, total: Column, squares: Column) -> Column:
    """Sample variance from sums; 0 below two values, never negative."""
    return F.when(n > 1, F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))).otherwise(F.lit(0.0))


def mean(n: Column, total: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def exact_sum(x: Column) -> Column:
    """Sum of doubles as an aggregate, whatever their order: whole numbers, whole multiples of 2**-26 and what is left are
    added apart, the first two without rounding up to 2**53. So a mean that lies on a threshold or on a tie stays there."""
    whole = F.rint(x)
    rest = (x - whole) * F.lit(2.0**26)
    return F.nanvl(F.sum(whole) + (F.sum(F.rint(rest)) + F.sum(rest - F.rint(rest))) * F.lit(2.0**-26), F.sum(x))


def welch_z(delta: Column, v_in: Column, n_in: Column, v_out: Column, n_out: Column) -> Column:
    return delta / F.sqrt(v_in / n_in + v_out / n_out + TINY)


def cohens_d(delta: Column, v_in: Column, n_in: Column, v_out: Column, n_out: Column) -> Column:
    pooled = ((n_in - 1) * v_in + (n_out - 1) * v_out) / F.greatest(F.lit(1), n_in + n_out - 2)
    return delta / F.sqrt(pooled + TINY)


def entropy(p: Column) -> Column:
    """Of a yes/no variable, in nats."""
    term = lambda q: F.when(q > 0, -q * F.ln(q + TINY)).otherwise(F.lit(0.0))
    return term(p) + term(1 - p)


def normalized_mi(p11: Column, pi: Column, pj: Column) -> Column:
    """Mutual information of two yes/no variables over the root of their entropies' product."""
    clip = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(1e-7), p))
    part = lambda p, q: clip(p) * F.ln(clip(p) / (q + 1e-7))
    p10, p01 = pi - p11, pj - p11
    mi = part(p11, pi * pj) + part(p10, pi * (1 - pj)) + part(p01, (1 - pi) * pj) + part(F.lit(1.0) - p11 - p10 - p01, (1 - pi) * (1 - pj))
    return mi / (F.sqrt(entropy(pi) * entropy(pj)) + 1e-7)


def corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null for fewer than two rows or where a side doesn't vary."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    n, vx, vy = F.count(F.lit(1)), F.var_pop(x), F.var_pop(y)
    return F.when((n >= 2) & (vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(F.nullif(vx * vy, F.lit(0.0))))


def slope(x: str, y: str) -> Column:
    """Least-squares slope of y on x; null where x doesn't vary."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    return F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0))


def r6(x: Column, digits: int = 6) -> Column:
    """Six decimals (or so many), and no negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)
