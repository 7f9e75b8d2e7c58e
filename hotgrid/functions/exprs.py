"""Column expressions that several stages share; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Incident types by category (fixed values: results depend on them).
VIOLENT = ("BATTERY", "ASSAULT", "ROBBERY", "HOMICIDE", "CRIMINAL SEXUAL ASSAULT", "SEX OFFENSE", "KIDNAPPING", "INTIMIDATION")
PROPERTY = ("THEFT", "BURGLARY", "MOTOR VEHICLE THEFT", "CRIMINAL DAMAGE", "DECEPTIVE PRACTICE", "ARSON")
ISO_FORMAT, US_FORMAT = "yyyy-MM-dd HH:mm:ssXXX", "MM/dd/yyyy hh:mm:ss a"


def parse_ts(c: str | Column) -> Column:
    """A timestamp in either of the two source formats; null where neither fits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(c, F.lit(ISO_FORMAT)), F.try_to_timestamp(c, F.lit(US_FORMAT)))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds a value; null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_ratio(num: Column, den: Column, bound: float | None = None, default: float = 0.0) -> Column:
    """num / den, the default where den is null or near 0; null num stays null; clipped on both sides."""
    ratio = F.when(F.abs(den) > 1e-12, num / den).otherwise(F.lit(default))
    return clip(ratio, -bound, bound) if bound is not None else ratio


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance on a sphere of 6371 km; the cosine is clamped, so equal points are 0 apart."""
    a, b = F.radians(lat1), F.radians(lat2)
    cos = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.lit(6371.0) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def category(primary_type: str | Column = "primary_type") -> Column:
    t = F.col(primary_type) if isinstance(primary_type, str) else primary_type
    return F.when(t.isin(*VIOLENT), "VIOLENT").when(t.isin(*PROPERTY), "PROPERTY").otherwise("OTHER")


def type_flags(primary_type: str = "primary_type") -> dict[str, Column]:
    t = F.col(primary_type)
    return {
        "is_violent": t.isin(*VIOLENT).cast("int"),
        "is_property": t.isin(*PROPERTY).cast("int"),
        "is_theft": (t == "THEFT").cast("int"),
        "is_battery": (t == "BATTERY").cast("int"),
        "is_narcotics": t.rlike("NARCOTIC|DRUG").cast("int"),
    }


def hour_flags(hour: Column) -> dict[str, Column]:
    return {
        "is_night": (hour.isin(22, 23) | (hour <= 5)).cast("int"),
        "is_morning": hour.between(6, 11).cast("int"),
        "is_afternoon": hour.between(12, 17).cast("int"),
        "is_evening": hour.between(18, 21).cast("int"),
    }


def calendar(date: str = "date") -> dict[str, Column]:
    """Monday is 0; cycles have periods of 7, 12 and 366."""
    d = F.col(date)
    dow, month, doy = F.weekday(d), F.month(d), F.dayofyear(d)
    cycle = lambda x, p: x * (2 * math.pi / p)
    return {
        "dayofweek": dow,
        "month": month,
        "dayofyear": doy,
        "is_weekend": (dow >= 5).cast("int"),
        "is_monday": (dow == 0).cast("int"),
        "is_friday": (dow == 4).cast("int"),
        "dow_sin": F.sin(cycle(dow, 7)),
        "dow_cos": F.cos(cycle(dow, 7)),
        "month_sin": F.sin(cycle(month, 12)),
        "month_cos": F.cos(cycle(month, 12)),
        "doy_sin": F.sin(cycle(doy, 366)),
        "doy_cos": F.cos(cycle(doy, 366)),
    }


def sunday_week(date: str | Column) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.date_sub(d, F.dayofweek(d) - 1)


def fixed_risk(p: Column) -> Column:
    return F.when(p < 0.3, "LOW").when(p < 0.6, "MEDIUM").when(p < 0.8, "HIGH").otherwise("CRITICAL")


def version_label(date: Column, prefix: str = "groupblend") -> Column:
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("." + prefix))


def finite(x: Column) -> Column:
    """Infinite and NaN values become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def padded(text: str | Column, width: int) -> Column:
    """``text`` with zeros before it up to ``width``; a longer one stays whole, which ``lpad`` would cut."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
