"""Outbreak alerts: a week's count against the place's mean week."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window as W

from casewatch import presets
from casewatch.functions.dates import iso_week_monday
from casewatch.functions.numbers import round_up, safe_ratio
from casewatch.functions.text import title_words
from casewatch.operators.aggregates import n_rows, top
from casewatch.operators.clean import where_equals


@dataclass(frozen=True)
class AlertRule:
    """Thresholds as multiples of the mean week, and how many weeks count."""

    keep: float
    medium: float
    high: float
    last_weeks: int
    limit: int | None = None
    mean_digits: int = 2
    title_case: bool = False


# The two published alert definitions.
LATEST_WEEK = AlertRule(keep=1.2, medium=1.5, high=2.0, last_weeks=1, title_case=True)
RECENT_WEEKS = AlertRule(
    keep=2.0, medium=2.0, high=3.0, last_weeks=5, limit=20, mean_digits=1
)


def outbreak_alerts(
    df: DataFrame,
    disease: str,
    rule: AlertRule = LATEST_WEEK,
    place: str = "Departamento_ocurrencia",
    week: str = "SEMANA",
    year: str = "ANO",
    count: str | None = None,
    by_year: bool = False,
) -> DataFrame:
    """Place-weeks whose count reaches ``keep`` times the place's mean week.

    Weeks of different years fall together unless ``by_year``. ``count`` names
    the measure of aggregated input. Cases are counted map-side; the window
    and the latest-week subquery see only one row per place and week, and both
    read the same shuffle.
    """
    total = F.sum(count) if count else n_rows()
    time = [year, week] if by_year else [week]
    weekly = where_equals(df, enfermedad=disease).groupBy(place, *time).agg(
        total.alias("casos_semana")
    )
    if by_year:
        index = F.floor(F.datediff(iso_week_monday(year, week), F.lit("1970-01-05")) / 7)
    else:
        index = F.col(week)
    mean = F.avg("casos_semana").over(W.partitionBy(place))
    cases, usual = F.col("casos_semana"), F.col("_mean")
    # Reading the count keeps the grouping in this subquery, so that it reuses
    # the weekly shuffle; a bare maximum would scan the cases a second time.
    last = weekly.agg(F.max(F.when(cases > 0, index))).scalar()
    alerts = (
        weekly.withColumns({"_mean": mean, "_index": index})
        .filter((F.col("_index") >= last - (rule.last_weeks - 1)) & (cases >= usual * rule.keep))
        .select(
            (title_words(place) if rule.title_case else F.col(place)).alias("departamento"),
            *([F.col(year)] if by_year else []),
            F.col(week).alias("semana"),
            "casos_semana",
            round_up(usual, rule.mean_digits).alias("promedio_historico"),
            round_up(safe_ratio(cases, usual), 2).alias("ratio"),
            F.when(cases >= usual * rule.high, "ALTO")
            .when(cases >= usual * rule.medium, "MEDIO")
            .otherwise("BAJO").alias("nivel_alerta"),
        )
    )
    if rule.limit is None:
        return alerts
    return top(alerts, "ratio", "departamento", "semana", n=rule.limit)


def alert_rollup(alerts: DataFrame, department: str | None = None) -> DataFrame:
    """Overall severity of the alerts, optionally of one department.

    One row; no alert at all reads ``NINGUNO``.
    """
    rank = F.array_position(
        F.array(*[F.lit(x) for x in presets.ALERT_SEVERITY]), F.col("nivel_alerta")
    )
    wanted = where_equals(alerts, departamento=department)
    return wanted.agg(
        F.element_at(
            F.array(*[F.lit(x) for x in presets.ALERT_SEVERITY]),
            F.coalesce(F.max(rank), F.lit(1)).cast("int"),
        ).alias("nivel_global"),
        n_rows().alias("alertas"),
    )


def departments_at_risk(alerts: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` alerts of the highest level, by ratio."""
    high = alerts.filter(F.col("nivel_alerta") == "ALTO")
    return top(high, "ratio", "departamento", "semana", n=n).select("departamento", "ratio")
