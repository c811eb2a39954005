"""Case classification, season, climate and target expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from casewatch import presets
from casewatch.functions.numbers import round_even, within
from casewatch.functions.text import col, lookup


def recode_sex(value: str | Column) -> Column:
    text = col(value)
    recoded = F.coalesce(lookup(text, presets.SEX_RECODE), text)
    return F.when(recoded.isin("M", "F"), recoded)


def age_in_years(age: str | Column, unit: str | Column) -> Column:
    """Age in years at two decimals; units other than months, days, hours pass."""
    value, code = col(age).cast("double"), col(unit)
    years = value
    for unit_code, per_year in presets.UNITS_PER_YEAR.items():
        years = F.when(code == unit_code, value / per_year).otherwise(years)
    return within(round_even(years, 2), presets.AGE_RANGE)


def _step_label(value: Column, steps: list[tuple[int, str]], last: str, closed: bool) -> Column:
    """Label of the first step whose bound holds the value."""
    result = None
    for bound, label in steps:
        inside = value <= bound if closed else value < bound
        result = F.when(inside, label) if result is None else result.when(inside, label)
    return result.otherwise(last)


def age_group(age: str | Column) -> Column:
    years = col(age)
    label = _step_label(years, presets.AGE_GROUPS, presets.AGE_GROUP_LAST, closed=True)
    return F.when(years > -1, label).otherwise(presets.NO_LABEL)


def risk_label(
    count: str | Column,
    low: int = presets.RISK_LABELS[0][0],
    medium: int = presets.RISK_LABELS[1][0],
) -> Column:
    """Weekly risk label; both bounds belong to the lower label."""
    steps = [(low, presets.RISK_LABELS[0][1]), (medium, presets.RISK_LABELS[1][1])]
    return _step_label(col(count), steps, presets.RISK_LABEL_LAST, closed=True)


def outbreak_level(cases: str | Column) -> Column:
    return _step_label(
        col(cases), presets.OUTBREAK_LEVELS, presets.OUTBREAK_LEVEL_LAST, closed=False
    )


def decode(value: str | Column, table: dict) -> Column:
    return F.coalesce(lookup(col(value), table), F.lit(presets.NO_LABEL))


def decode_insurance(value: str | Column) -> Column:
    """As ``decode``, but an unknown code stays visible."""
    code = col(value)
    return F.coalesce(
        lookup(code, presets.INSURANCE_TYPES), code, F.lit(presets.NO_LABEL)
    )


def confirmed_flag(flag: str | Column, status: str | Column, case_type: str | Column) -> Column:
    by_status = F.upper(col(status)).contains(presets.CONFIRMED_WORD)
    by_type = col(case_type).isin(presets.CONFIRMED_CASE_TYPES)
    confirmed = F.coalesce(by_status, F.lit(False)) | F.coalesce(by_type, F.lit(False))
    return F.when(confirmed, 1).otherwise(F.coalesce(col(flag).cast("int"), F.lit(0)))


def is_rainy(month: str | Column) -> Column:
    return col(month).isin(presets.RAINY_MONTHS).cast("int")


def is_high_transmission(month: str | Column) -> Column:
    return col(month).isin(presets.HIGH_TRANSMISSION_MONTHS).cast("int")


def quarter(month: str | Column) -> Column:
    return F.ceil(col(month) / 3).cast("int")


def semester(month: str | Column) -> Column:
    return F.when(col(month) <= 6, 1).otherwise(2)


def month_angle(month: str | Column) -> Column:
    return F.lit(2 * math.pi) * col(month).cast("double") / F.lit(12)


def _unit_clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def climate_risk_score(
    temp: str | Column, rain: str | Column, humidity: str | Column,
    tropical: str | Column, rainy: str | Column,
) -> Column:
    score = (
        F.lit(0.35) * _unit_clip((col(temp) - 14.0) / 16.0)
        + F.lit(0.25) * _unit_clip(col(rain) / 3000.0)
        + F.lit(0.20) * _unit_clip(col(humidity) / 100.0)
        + F.lit(0.15) * col(tropical)
        + F.lit(0.05) * col(rainy)
    )
    return round_even(score, 4)


def yes_no(condition: Column) -> Column:
    return F.when(condition, "SI").otherwise("NO")


def tropical_flag(score: str | Column) -> Column:
    return yes_no(col(score) >= presets.TROPICAL_MIN_SCORE)


def vector_flag(temp: str | Column, humidity: str | Column, score: str | Column) -> Column:
    return yes_no(
        (col(temp) >= presets.VECTOR_MIN_TEMP)
        & (col(humidity) >= presets.VECTOR_MIN_HUMIDITY)
        & (col(score) >= presets.VECTOR_MIN_SCORE)
    )


def transform_target(value: str | Column, method: str) -> Column:
    if method == "log1p":
        return F.log1p(col(value))
    if method == "sqrt":
        return F.sqrt(col(value))
    return col(value)


def inverse_target(value: str | Column, method: str) -> Column:
    if method == "log1p":
        return F.expm1(col(value))
    if method == "sqrt":
        return col(value) * col(value)
    return col(value)


def sample_weight(value: str | Column) -> Column:
    return F.lit(1.0) + F.log1p(col(value))
