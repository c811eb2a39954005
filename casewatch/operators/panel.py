"""Monthly feature panel: densified counts, season, climate, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewatch import presets
from casewatch.functions import dates, epi, text
from casewatch.operators.align import require_columns
from casewatch.operators.clean import known_places
from casewatch.operators.windows import ENTITY, temporal_features

REQUIRED = [
    "enfermedad", "ANO", "SEMANA", "Departamento_ocurrencia", "Municipio_ocurrencia",
]


def month_counts(cases: DataFrame) -> DataFrame:
    """Cases per disease, year and place with one column per month.

    Raw values are counted first and only the distinct ones are normalised:
    the text work does not grow with the number of cases.
    """
    require_columns(cases, REQUIRED)
    notified = F.col("FEC_NOT") if "FEC_NOT" in cases.columns else F.lit(None).cast("date")
    month = dates.case_month(notified, "ANO", "SEMANA")
    present = known_places(
        cases.filter(F.col("enfermedad").isNotNull() & F.col("ANO").isNotNull()),
        "Departamento_ocurrencia", "Municipio_ocurrencia",
    )
    raw = present.groupBy(
        F.col("enfermedad").alias("disease"), F.col("ANO").cast("int").alias("year"),
        month.alias("month"),
        F.col("Departamento_ocurrencia").alias("department"),
        F.col("Municipio_ocurrencia").alias("municipality"),
    ).agg(F.count(F.lit(1)).alias("n")).filter(F.col("month").isNotNull())
    named = raw.select(
        text.normalize_disease("disease").alias("disease"), "year", "month",
        text.normalize_name("department").alias("department"),
        text.normalize_name("municipality").alias("municipality"), "n",
    )
    # Blank names became the sentinel. The test also reads the count, or the
    # optimizer would move it, and the text work with it, below the first
    # aggregate to every single case.
    known = F.when(
        F.col("n") > 0,
        (F.col("department") != presets.NO_DATA) & (F.col("municipality") != presets.NO_DATA),
    )
    return named.filter(known).groupBy(
        "disease", "year", "department", "municipality"
    ).agg(*[
        F.coalesce(F.sum(F.when(F.col("month") == m, F.col("n"))), F.lit(0)).alias(f"m{m}")
        for m in range(1, 13)
    ])


def monthly_panel(cases: DataFrame) -> DataFrame:
    """Twelve rows per disease, year and place; months without cases hold zero.

    The twelve counts of an entity are columns of one hash aggregate and are
    unfolded into rows: no scaffold join, no second pass. Rows leave
    partitioned by entity, as the lag windows want them.
    """
    entities = month_counts(cases).repartition(*ENTITY)
    months = F.array(*[
        F.struct(F.lit(m).alias("month"), F.col(f"m{m}").cast("double").alias(presets.TARGET))
        for m in range(1, 13)
    ])
    return entities.select("disease", "year", "department", "municipality", F.inline(months))


def climate_profiles(
    spark: SparkSession, rows: list[tuple] = presets.CLIMATE_PROFILES
) -> DataFrame:
    """The fixed climate table: one row per department, a few dozen in all."""
    kinds = "department string, thermal_floor string, " + ", ".join(
        f"{c} double" for c in presets.CLIMATE_COLUMNS[2:]
    )
    return spark.createDataFrame(rows, kinds)


def with_climate_profile(
    df: DataFrame,
    profiles: DataFrame | None = None,
    default: tuple = presets.DEFAULT_CLIMATE,
    reference_compat: bool = False,
) -> DataFrame:
    """Climate columns by department, with a default for unknown ones.

    Both sides are matched accent-free. ``reference_compat`` matches the
    table's names as written, so an accented one is never found.
    """
    if profiles is None:
        # The built-in table has a fixed, small size.
        profiles = F.broadcast(climate_profiles(df.sparkSession))
    key = F.col("department") if reference_compat else text.normalize_name("department")
    side = profiles.withColumn("_place", key).drop("department")
    joined = df.withColumn("_place", text.normalize_name("department")).join(
        side, "_place", "left"
    )
    columns = presets.CLIMATE_COLUMNS[1:]
    return joined.withColumns({
        name: F.coalesce(F.col(name), F.lit(value))
        for name, value in zip(columns, default, strict=True)
    }).drop("_place")


def season_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "quarter": epi.quarter("month"),
        "semester": epi.semester("month"),
        "is_rainy_season": epi.is_rainy("month"),
        "is_high_transmission_month": epi.is_high_transmission("month"),
        "is_tropical_climate": epi.tropical_flag("tropical_score"),
        "is_vector_favorable": epi.vector_flag("avg_temp_c", "humidity_pct", "tropical_score"),
        "climate_risk_score": epi.climate_risk_score(
            "avg_temp_c", "precipitation_mm", "humidity_pct", "tropical_score",
            epi.is_rainy("month"),
        ),
        "month_sin": F.sin(epi.month_angle("month")),
        "month_cos": F.cos(epi.month_angle("month")),
    })


def climate_features(df: DataFrame, **options) -> DataFrame:
    return season_features(with_climate_profile(df, **options))


def training_panel(cases: DataFrame, **climate_options) -> DataFrame:
    """Panel with all features that do not depend on priors; one lazy plan."""
    return climate_features(temporal_features(monthly_panel(cases)), **climate_options)


def scoring_scaffold(cases: DataFrame) -> DataFrame:
    """Distinct disease and place times the twelve months.

    Distinct raw values are taken first, so names are folded once each.
    """
    raw = cases.select(
        F.col("enfermedad").alias("disease"),
        F.col("Departamento_ocurrencia").alias("department"),
        F.col("Municipio_ocurrencia").alias("municipality"),
    ).dropna().distinct()
    names = known_places(raw, "department", "municipality").select(
        text.normalize_disease("disease").alias("disease"),
        text.normalize_name("department").alias("department"),
        text.normalize_name("municipality").alias("municipality"),
    ).distinct()
    return names.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
