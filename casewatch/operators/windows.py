"""Lag and trailing-window features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casewatch import presets

ENTITY = ["disease", "department", "municipality"]


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)).cast("double")


def temporal_features(
    panel: DataFrame,
    target: str = presets.TARGET,
    entity: Iterable[str] = ENTITY,
    time: Iterable[str] = ("year", "month"),
) -> DataFrame:
    """Previous-month value, trailing means and sums, and trends.

    Lags are row offsets within the entity, so they run across years and skip
    years without rows. A window holds one entity: twelve rows a year.
    """
    order = W.partitionBy(*entity).orderBy(*time)

    def lag(k: int) -> Column:
        return _zero(F.lag(target, k).over(order))

    def trailing(function, k: int) -> Column:
        return _zero(function(target).over(order.rowsBetween(-k, -1)))

    features = panel.withColumns({
        "cases_previous_month": lag(1),
        "_previous_2": lag(2),
        "cases_previous_2_month_mean": trailing(F.avg, 2),
        "cases_previous_3_month_mean": trailing(F.avg, 3),
        "cases_previous_6_month_mean": trailing(F.avg, 6),
        "cases_previous_3_month_sum": trailing(F.sum, 3),
        "cases_previous_6_month_sum": trailing(F.sum, 6),
    })
    return features.withColumns({
        "cases_trend_1m": F.col("cases_previous_month") - F.col("_previous_2"),
        "cases_trend_3m": (
            F.col("cases_previous_3_month_mean") - F.col("cases_previous_6_month_mean")
        ),
    }).drop("_previous_2")


def weekly_lags(
    df: DataFrame,
    measure: str,
    place: Iterable[str],
    time: Iterable[str],
    lags: Iterable[int] = (2, 4, 8),
    mean_weeks: int = 4,
) -> DataFrame:
    """Documented weekly features: lags and a trailing mean with the current week."""
    order = W.partitionBy(*place).orderBy(*time)
    recent = F.avg(measure).over(order.rowsBetween(-(mean_weeks - 1), 0))
    return df.withColumns({
        **{f"{measure}_lag_{k}w": F.lag(measure, k).over(order) for k in lags},
        f"{measure}_ma{mean_weeks}": recent,
    })
