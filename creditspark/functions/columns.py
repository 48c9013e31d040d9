"""Column expressions: null and zero rules, recodes, bins, tiers, formats, power transforms."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- null and zero rules -------------------------------------------------------------------

def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: turn NaN of every floating column into NULL."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` as double; NULL when ``b`` is 0 or either side is NULL."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def share(condition: Column) -> Column:
    """Share of rows meeting ``condition``; a NULL condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def null_above(c: Column | str, limit: float) -> Column:
    """Sentinel clean-up: values above ``limit`` become NULL."""
    c = as_col(c)
    return F.when(c > limit, F.lit(None)).otherwise(c)


def row_sum(cols: Iterable[Column | str]) -> Column:
    """Sum across columns, skipping NULLs; 0 when all are NULL."""
    return reduce(add, [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in cols], F.lit(0.0))


def recode(c: Column | str, mapping: Mapping[object, object]) -> Column:
    """Map listed values; anything else becomes NULL."""
    c = as_col(c)
    out = F.lit(None)
    for key, value in mapping.items():
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out


def yes_no(c: Column | str) -> Column:
    return recode(c, {"Y": 1, "N": 0})


def missing_flag(c: Column | str) -> Column:
    return as_col(c).isNull().cast("int")


# ---- bins and tiers ------------------------------------------------------------------------

def cut(c: Column | str, edges: Sequence[float | None], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]``; NULL outside. ``None`` is an open end."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one label per interval is needed")
    c = as_col(c)
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = c.isNotNull()
        if low is not None:
            inside = inside & (c > F.lit(low))
        if high is not None:
            inside = inside & (c <= F.lit(high))
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


# Interval edges and labels, in order.
EMPLOYMENT_EDGES = [None, -1825, -1095, -365, 0]
EMPLOYMENT_LABELS = [">5y", "3-5y", "1-3y", "<1y"]
AGE_EDGES = [0, 25, 35, 45, 55, None]
AGE_LABELS = ["<25", "25-35", "35-45", "45-55", "55+"]
DAYS_PER_YEAR = 365.0
EMPLOYMENT_SENTINEL_ABOVE = 36500


def years(days: Column | str) -> Column:
    """Day offset before the application (negative) to years."""
    return -as_col(days) / F.lit(DAYS_PER_YEAR)


def employment_band(days: Column | str) -> Column:
    return cut(days, EMPLOYMENT_EDGES, EMPLOYMENT_LABELS)


def age_band(days_birth: Column | str) -> Column:
    return cut(years(days_birth), AGE_EDGES, AGE_LABELS)


def tier(c: Column, steps: Sequence[tuple[float, str]], top: str) -> Column:
    """First label whose bound exceeds ``c``, else ``top``; NULL stays NULL."""
    out = F.lit(top)
    for bound, label in reversed(steps):
        out = F.when(c < bound, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def risk_tier(p: Column | str) -> Column:
    """``high`` above 0.7, ``moderate`` above 0.3, else ``low``; NULL stays NULL."""
    p = as_col(p)
    label = F.when(p > 0.7, "high").when(p > 0.3, "moderate").otherwise("low")
    return F.when(p.isNotNull(), label)


def missing_tier(*percents: Column | str) -> Column:
    """``High`` when any percent is above 50, ``Medium`` above 10, else ``Low``."""
    most = F.greatest(*percents) if len(percents) > 1 else percents[0]
    most = as_col(most)
    return F.when(most > 50, "High").when(most > 10, "Medium").otherwise("Low")


def decision(p: Column | str, threshold: float = 0.5) -> Column:
    return (as_col(p) > threshold).cast("int")


def significance(p: Column | str) -> Column:
    p = as_col(p)
    label = F.when(p < 0.05, "Statistically significant").otherwise("Not statistically significant")
    return F.when(p.isNotNull(), label)


def rank_effect_tier(effect: Column | str) -> Column:
    steps = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]
    return tier(F.abs(as_col(effect)), steps, "large")


def median_effect_tier(effect: Column | str) -> Column:
    return tier(F.abs(as_col(effect)), [(0.2, "small"), (0.5, "medium")], "large")


def association_tier(v: Column | str) -> Column:
    steps = [(0.1, "negligible"), (0.3, "small"), (0.5, "medium")]
    return tier(F.abs(as_col(v)), steps, "large")


def stability_tier(cv: Column | str) -> Column:
    steps = [(0.05, "very stable"), (0.1, "reasonably stable")]
    return tier(as_col(cv), steps, "significant variation")


# ---- power transforms and scaling ----------------------------------------------------------

def box_cox(c: Column | str, lam: float = 0.15) -> Column:
    """Box-Cox of ``1 + x`` for positive x; other values and NULL unchanged."""
    c = as_col(c).cast("double")
    moved = F.log1p(c) if lam == 0 else (F.pow(1 + c, F.lit(lam)) - 1) / lam
    return F.when(c > 0, moved).otherwise(c)


def box_cox_inverse(c: Column | str, lam: float = 0.15) -> Column:
    c = as_col(c).cast("double")
    back = F.expm1(c) if lam == 0 else F.pow(c * lam + 1, F.lit(1.0 / lam)) - 1
    return F.when(c > 0, back).otherwise(c)


def weighted_mean(weights: Sequence[float], cols: Sequence[Column | str]) -> Column:
    total = float(sum(weights))
    parts = [as_col(c) * F.lit(float(w)) for w, c in zip(weights, cols, strict=True)]
    return reduce(add, parts) / F.lit(total)


# ---- text ----------------------------------------------------------------------------------

def clean_name(name: str) -> str:
    """Runs of characters outside letters, digits and underscore become one underscore."""
    import re

    return re.sub(r"\W+", "_", name)


def clean_value(c: Column | str) -> Column:
    """:func:`clean_name` on the values of a column, with Unicode letters kept."""
    return F.regexp_replace(as_col(c), r"(?U)\W+", "_")


def number_text(c: Column | str) -> Column:
    """Whole numbers without decimals, others with two."""
    c = as_col(c).cast("double")
    whole = F.format_string("%.0f", c)
    return F.when(c == F.floor(c), whole).when(c.isNotNull(), F.format_string("%.2f", c))


def variant_base(c: Column | str) -> Column:
    """Feature name without its ``_AVG``, ``_MODE`` or ``_MEDI`` suffix."""
    return F.regexp_replace(as_col(c), "_(AVG|MODE|MEDI)$", "")


def title_text(c: Column | str) -> Column:
    return F.initcap(F.regexp_replace(as_col(c), "_", " "))
