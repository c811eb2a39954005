"""Weekly aggregate, rankings, distributions, series and pick lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casewatch import presets
from casewatch.functions import dates, epi, text
from casewatch.functions.numbers import exact_mean, half_up_percent, round_up, safe_ratio
from casewatch.operators.clean import known_places, known_sex, where_equals

DEPARTMENT = "Departamento_ocurrencia"
MUNICIPALITY = "Municipio_ocurrencia"


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_hospitalised() -> Column:
    return F.count_if(F.col("hospitalizado") == presets.HOSPITAL_STATUS[1])


def n_deaths() -> Column:
    return F.count_if(F.col("condicion_final") == presets.FINAL_CONDITIONS[2])


def n_women() -> Column:
    return F.count_if(F.col("SEXO") == "F")


def top(df: DataFrame, measure: str, *ties: str, n: int) -> DataFrame:
    """Largest ``n`` rows by a measure; ties resolved by the named columns."""
    return df.orderBy(F.desc_nulls_last(measure), *[F.asc_nulls_first(t) for t in ties]).limit(n)


def page(df: DataFrame, order_by: list[str], size: int, start: int = 0) -> DataFrame:
    """Rows ``start`` to ``start + size`` in the given order."""
    return df.orderBy(*order_by).offset(start).limit(size)


def with_share(grouped: DataFrame, count: str, name: str, digits: int) -> DataFrame:
    """Percentage of the grand total of already grouped rows.

    The total is a scalar subquery over the same groups; a window without keys
    would gather all groups in one task. The subquery mentions every column,
    so that its groups equal the query's and Spark reuses their shuffle
    instead of scanning the cases again.
    """
    others = [F.max(c).alias(c) for c in grouped.columns if c != count]
    totals = grouped.agg(F.struct(F.sum(count).alias("_total"), *others)).scalar()
    total = totals.getField("_total")
    return grouped.withColumn(name, round_up(safe_ratio(F.col(count) * 100, total), digits))


# --- weekly aggregate ---------------------------------------------------------

def weekly_aggregate(
    cases: DataFrame,
    order_by: str | None = None,
    low: int = presets.RISK_LABELS[0][0],
    medium: int = presets.RISK_LABELS[1][0],
) -> DataFrame:
    """Cases per disease, year, week and department (null keys are groups).

    Two steps. The first also groups by department code and keeps only
    fixed-width sums, so it stays a hash aggregate with map-side combine. The
    second merges the few rows per group and picks the first non-null code by
    ``order_by``, a number (without it: the smallest code).
    """
    keys = ["enfermedad", "ANO", "SEMANA", DEPARTMENT]
    first_at = [F.min(order_by).alias("first_at")] if order_by else []
    partial = cases.groupBy(*keys, "COD_DPTO_O").agg(
        n_rows().alias("n"),
        F.sum("confirmados").alias("confirmados"),
        n_hospitalised().alias("hospitalizados"),
        n_deaths().alias("fallecidos"),
        F.sum(F.rint(F.col("edad_anos") * 100).cast("long")).alias("age_sum"),
        F.count("edad_anos").alias("age_n"),
        n_women().alias("women"),
        *first_at,
    )
    order = F.col("first_at" if order_by else "COD_DPTO_O")
    first_code = F.min_by("COD_DPTO_O", F.when(F.col("COD_DPTO_O").isNotNull(), order))
    grouped = partial.groupBy(*keys).agg(
        F.sum("n").alias("total_casos"),
        F.coalesce(F.sum("confirmados"), F.lit(0)).alias("confirmados"),
        F.sum("hospitalizados").alias("hospitalizados"),
        F.sum("fallecidos").alias("fallecidos"),
        (F.rint(safe_ratio(F.sum("age_sum"), F.sum("age_n"))) / 100).alias("edad_promedio"),
        (F.rint(safe_ratio(F.sum("women") * 10000, F.sum("n"))) / 100).alias("pct_femenino"),
        first_code.alias("cod_dpto"),
    )
    return grouped.withColumnsRenamed({"ANO": "año", DEPARTMENT: "departamento"}).withColumns({
        "month": dates.iso_week_month("año", "SEMANA"),
        "risk_label": epi.risk_label("total_casos", low, medium),
    })


def sort_weekly(weekly: DataFrame) -> DataFrame:
    return weekly.orderBy("enfermedad", "departamento", "año", "SEMANA")


# --- summaries ------------------------------------------------------------------

def disease_summary(cases: DataFrame, truncate: bool = False) -> DataFrame:
    """Count, hospitalised, mean age and percentage of women per disease.

    ``truncate`` is the second published form: deaths added, age at one
    decimal, percentage cut to an integer.
    """
    measures = [n_rows().alias("total_casos"), n_hospitalised().alias("hospitalizados")]
    if truncate:
        measures += [
            n_deaths().alias("fallecidos"),
            exact_mean("edad_anos", out=1, half_up=True).alias("edad_promedio"),
            F.floor(n_women() * 100 / n_rows()).alias("pct_femenino"),
        ]
        return cases.groupBy("enfermedad").agg(*measures)
    measures += [
        exact_mean("edad_anos", half_up=True).alias("edad_promedio"),
        round_up(n_women() * 100.0 / n_rows(), 2).alias("pct_femenino"),
    ]
    summary = cases.groupBy("enfermedad").agg(*measures)
    return summary.withColumn("enfermedad", text.title_words("enfermedad"))


def hospital_share(summary: DataFrame) -> DataFrame:
    """Whole hospitalised percentage for the indicator cards."""
    return summary.withColumn(
        "pct_hospitalizados",
        half_up_percent(F.col("hospitalizados"), F.col("total_casos")),
    )


def peak_week(
    df: DataFrame, disease: str, count: str | None = None, by_year: bool = False,
    year: str = "ANO",
) -> DataFrame:
    """Week with most cases; ``count`` names the measure of aggregated input."""
    total = F.sum(count) if count else n_rows()
    keys = ([year] if by_year else []) + ["SEMANA"]
    weeks = where_equals(df, enfermedad=disease).groupBy(*keys).agg(total.alias("casos_pico"))
    renamed = weeks.withColumnRenamed("SEMANA", "semana_pico")
    return top(renamed, "casos_pico", "semana_pico", *keys[:-1], n=1)


def weekly_by_place(weekly: DataFrame) -> DataFrame:
    """Cases and hospitalised per disease, department and week of the year."""
    grouped = weekly.groupBy("enfermedad", "departamento", "SEMANA").agg(
        F.sum("total_casos").alias("casos"),
        F.sum("hospitalizados").alias("hospitalizados"),
    )
    return grouped.select(
        text.title_words("enfermedad").alias("enfermedad"),
        text.title_words("departamento").alias("departamento"),
        F.col("SEMANA").alias("semana"), "casos", "hospitalizados",
    )


def weekly_series(
    cases: DataFrame, disease: str, department: str | None = None
) -> DataFrame:
    """Cases and hospitalised per week for one disease, optionally one department."""
    wanted = where_equals(cases, enfermedad=disease, **{DEPARTMENT: department})
    return wanted.groupBy(F.col("SEMANA").alias("semana")).agg(
        n_rows().alias("casos"), n_hospitalised().alias("hospitalizados")
    )


def sum_by_key(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Sums per key; a null key becomes a label, null measures count as zero."""
    label = F.coalesce(F.col(key).cast("string"), F.lit(presets.NO_LABEL))
    return df.groupBy(label.alias(key)).agg(*[
        F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields
    ])


# --- rankings -------------------------------------------------------------------

def department_ranking(cases: DataFrame, disease: str, n: int = 20) -> DataFrame:
    grouped = where_equals(cases, enfermedad=disease).groupBy(
        F.col(DEPARTMENT).alias("departamento")
    ).agg(
        n_rows().alias("casos"), n_hospitalised().alias("hospitalizados"),
        n_deaths().alias("fallecidos"),
    )
    return top(with_share(grouped, "casos", "pct_nacional", 2), "casos", "departamento", n=n)


def department_cases(weekly: DataFrame) -> DataFrame:
    """Cases per disease and department from the weekly aggregate."""
    grouped = weekly.groupBy("enfermedad", "departamento").agg(
        F.sum("total_casos").alias("casos")
    )
    return grouped.withColumns({
        "enfermedad": text.title_words("enfermedad"),
        "departamento": text.title_words("departamento"),
    })


def municipality_ranking(
    cases: DataFrame, disease: str, department: str, n: int = 15
) -> DataFrame:
    wanted = where_equals(cases, enfermedad=disease, **{DEPARTMENT: department})
    grouped = wanted.groupBy(
        F.col(MUNICIPALITY).alias("municipio"), F.col("COD_MUN_O").alias("cod_dane")
    ).agg(n_rows().alias("casos"))
    return top(grouped, "casos", "municipio", "cod_dane", n=n)


def municipality_cases(cases: DataFrame) -> DataFrame:
    """Cases per disease, department and known municipality."""
    grouped = known_places(cases, MUNICIPALITY).groupBy(
        "enfermedad", DEPARTMENT, MUNICIPALITY
    ).agg(n_rows().alias("casos"))
    return grouped.select(
        text.title_words("enfermedad").alias("enfermedad"),
        text.title_words(DEPARTMENT).alias("departamento"),
        text.title_words(MUNICIPALITY).alias("municipio"), "casos",
    )


def department_totals(cases: DataFrame, disease: str) -> DataFrame:
    return where_equals(cases, enfermedad=disease).groupBy(
        F.col(DEPARTMENT).alias("departamento")
    ).agg(
        n_rows().alias("total_casos"), n_hospitalised().alias("hospitalizados"),
        exact_mean("edad_anos", out=1, half_up=True).alias("edad_promedio"),
    )


# --- distributions ----------------------------------------------------------------

def age_distribution(
    cases: DataFrame, disease: str, department: str | None = None
) -> DataFrame:
    """Cases per age group with their share; ``orden`` sorts unknown last."""
    wanted = where_equals(cases, enfermedad=disease, **{DEPARTMENT: department})
    known = wanted.filter(F.col("grupo_etario").isNotNull() & (F.col("grupo_etario") != "None"))
    grouped = known.groupBy("grupo_etario").agg(
        n_rows().alias("casos"), F.min("edad_anos").alias("edad_min")
    )
    return with_share(grouped, "casos", "porcentaje", 1).withColumn(
        "orden", label_order("grupo_etario", presets.AGE_GROUP_ORDER)
    )


def age_by_place(cases: DataFrame) -> DataFrame:
    """Cases per disease, department and age group."""
    grouped = cases.groupBy("enfermedad", DEPARTMENT, "grupo_etario").agg(
        n_rows().alias("casos")
    )
    return grouped.select(
        text.title_words("enfermedad").alias("enfermedad"),
        text.title_words(DEPARTMENT).alias("departamento"), "grupo_etario", "casos",
    )


def label_order(column: str, labels: list[str]) -> Column:
    """Ordinal of a label in a fixed order; unknown labels sort last (99)."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(column))
    return F.when(position > 0, position - 1).otherwise(99).cast("int")


def sex_distribution(
    cases: DataFrame, disease: str, department: str | None = None
) -> DataFrame:
    """Cases per known sex with their share."""
    wanted = where_equals(cases, enfermedad=disease, **{DEPARTMENT: department})
    grouped = known_sex(wanted).groupBy(F.col("SEXO").alias("sexo")).agg(
        n_rows().alias("casos")
    )
    return with_share(grouped, "casos", "porcentaje", 1)


def sex_by_place(cases: DataFrame) -> DataFrame:
    """Cases and share per known sex within disease and department.

    The window runs over grouped rows: at most two per partition.
    """
    grouped = known_sex(cases).groupBy("enfermedad", DEPARTMENT, "SEXO").agg(
        n_rows().alias("casos")
    )
    whole = F.sum("casos").over(W.partitionBy("enfermedad", DEPARTMENT))
    return grouped.select(
        text.title_words("enfermedad").alias("enfermedad"),
        text.title_words(DEPARTMENT).alias("departamento"),
        F.col("SEXO").alias("sexo"), "casos",
        round_up(safe_ratio(F.col("casos") * 100, whole), 2).alias("porcentaje"),
    )


# --- counts and lists ---------------------------------------------------------------

def health_count(cases: DataFrame) -> DataFrame:
    return cases.agg(n_rows().alias("total_casos_db"))


def disease_counts(cases: DataFrame) -> DataFrame:
    """Rows per disease, null kept."""
    return cases.groupBy("enfermedad").agg(n_rows().alias("casos"))


def pick_list(df: DataFrame, column: str, **wanted: str | int | None) -> DataFrame:
    """Distinct non-empty values with a display label and a lookup key."""
    values = where_equals(df, **wanted).select(column).distinct()
    values = values.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return values.select(
        text.title_blank_separated(column).alias("label"),
        text.normalize_key(text.fold_accents(column)).alias("value"),
    )


def latest_load(audit: DataFrame) -> DataFrame:
    return top(audit, "loaded_at", "source", n=1)


# --- exploratory totals ----------------------------------------------------------------

def total_by(df: DataFrame, key: str, measure: str, n: int | None = None) -> DataFrame:
    totals = df.groupBy(key).agg(F.sum(measure).alias(measure))
    return totals if n is None else top(totals, measure, key, n=n)


def national_series(
    weekly: DataFrame, year: str = "año", week: str = "SEMANA", measure: str = "total_casos"
) -> DataFrame:
    """Cases per year and week with the Monday of that calendar week."""
    grouped = weekly.groupBy(year, week).agg(F.sum(measure).alias(measure))
    return grouped.withColumn("fecha", dates.calendar_week_monday(year, week))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(n_rows().alias("count"))


def seasonality(df: DataFrame, week: str = "SEMANA", measure: str = "total_casos") -> DataFrame:
    """Mean of a measure per week of the year."""
    return df.groupBy(week).agg(F.avg(measure).alias(f"mean_{measure}"))


def only_top(df: DataFrame, key: str, measure: str, n: int = 5) -> DataFrame:
    """All rows whose key is among the ``n`` largest by total measure."""
    leaders = total_by(df, key, measure, n).select(key)
    # At most n rows by construction.
    return df.join(F.broadcast(leaders), key, "left_semi")
