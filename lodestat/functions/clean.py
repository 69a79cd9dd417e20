"""Scalar cleaning rules of raw account columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(c: Column) -> Column:
    """``"12.5%"`` as 12.5; what is no number is null."""
    return F.rtrim(c, F.lit("%")).try_cast("double")


def null_if(c: Column, sentinel: str) -> Column:
    return F.nullif(c, F.lit(sentinel))


def recode(c: Column, labels: list[str], to: str) -> Column:
    return F.when(c.isin(labels), to).otherwise(c)


def month_year(c: Column) -> Column:
    """``Mon-yy`` as a date; years 69 to 99 belong to the last century, bad text is null."""
    d = F.try_to_date(c, "MMM-yy")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def fix_century(earliest: Column, issue: Column) -> Column:
    return F.when(earliest > issue, F.add_months(earliest, -1200)).otherwise(earliest)


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months."""
    return month_index(later) - month_index(earlier)


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("double")


def employment_years(c: Column) -> Column:
    """``< 1 year`` is 0; ``n/a`` is null."""
    return F.when(F.ltrim(c).startswith("<"), 0.0).otherwise(first_number(c))


def guarded_ratio(top: Column, below: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(below > 0, top / below)


def clipped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, floor: float = 1e-9) -> Column:
    q = clipped(p, floor, 1 - floor)
    return F.ln(q / (1 - q))


def log1p_clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def ladder(c: Column, labels: list[str]) -> Column:
    """A label's place; null if there is none."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), c) - 1, F.lit(-1).cast("long")).cast("int")


def iv_band(iv: Column) -> Column:
    # Upper limits of the bands of information value.
    return F.when(iv < 0.02, "useless").when(iv < 0.1, "weak").when(iv < 0.3, "medium").when(iv < 0.5, "strong").otherwise("suspicious")


def ladder_dummies(column: str, steps: list[tuple[float, float]]) -> dict[str, Column]:
    """A 0/1 column for each (lo, hi], and one for missing values."""
    c = F.col(column)
    out = {f"{column}_{lo:g}_{hi:g}": F.coalesce((c > lo) & (c <= hi), F.lit(False)).cast("int") for lo, hi in steps}
    return out | {f"{column}_missing": c.isNull().cast("int")}


def group_dummies(column: str, groups: dict[str, list[str]]) -> dict[str, Column]:
    return {f"{column}_{name}": F.coalesce(F.col(column).isin(*labels), F.lit(False)).cast("int") for name, labels in groups.items()}


def dummy_design(ladders: dict[str, list[tuple[float, float]]], groups: dict[str, dict[str, list[str]]], references: tuple[str, ...] = ()) -> dict[str, Column]:
    """All 0/1 columns of a design, made in one select; the reference levels are left out, and a name that is none of them is an error."""
    out: dict[str, Column] = {}
    for column, steps in ladders.items():
        out |= ladder_dummies(column, steps)
    for column, labels in groups.items():
        out |= group_dummies(column, labels)
    unknown = set(references) - set(out)
    if unknown:
        raise ValueError(f"references that no level has: {sorted(unknown)}")
    return {n: c for n, c in out.items() if n not in references}
