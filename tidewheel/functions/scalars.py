"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def standardize(x: Column, mean: Column, dev: Column) -> Column:
    return (x - mean) / (dev + EPS)


def destandardize(z: Column, mean: Column, dev: Column) -> Column:
    return z * (dev + EPS) + mean


def signed_square(x: Column) -> Column:
    return x * F.abs(x)


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x) + EPS)


def symlog(x: Column, c: float) -> Column:
    """Linear near 0, logarithmic far from it."""
    return F.signum(x) * F.log(1 + F.abs(x / c)) * c


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def latex_escape(text: Column) -> Column:
    """Characters that are special in LaTeX, escaped; a backslash is set aside first."""
    out = F.replace(text, F.lit("\\"), F.lit("\u0001"))
    for mark in "&%$#_{}":
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    for mark, name in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\u0001", "\\textbackslash{}")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def number(value: Column, dev: Column | None, decimals: int) -> Column:
    """A number as text with a fixed number of decimals, with its deviation if there is one; `--` for none."""
    show = lambda x: F.format_string(f"%.{decimals}f", x)
    plain = show(value)
    both = plain if dev is None else F.when(dev.isNull(), plain).otherwise(F.concat(plain, F.lit(" ± "), show(dev)))
    return F.when(value.isNull(), "--").otherwise(both)


def setting(text: Column) -> tuple[Column, Column]:
    """Lookback and horizon of `L_H` or `L:H`."""
    parts = F.split(text, "[_:]")
    return parts[0].cast("int"), parts[1].cast("int")


def gate(g: float, dev: Column) -> Column:
    return 1 + g * (1 / (dev + EPS) - 1)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))
