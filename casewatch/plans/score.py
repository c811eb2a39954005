"""Batch scoring of disease-place-months and publishing the predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from casewatch import presets
from casewatch.functions import epi, text
from casewatch.functions.numbers import round_even
from casewatch.operators import metrics
from casewatch.operators.panel import climate_features, scoring_scaffold
from casewatch.operators.priors import scoring_features
from casewatch.plans.train import Bundle, TrainedModel, numeric_as_double, predict_raw
from casewatch.session import materialize
from casewatch.sources import sinks

ECHOED_2 = [
    "avg_temp_c", "precipitation_mm", "humidity_pct", "tropical_score",
    "cases_previous_month", "cases_previous_2_month_mean",
    "cases_previous_3_month_mean", "cases_previous_6_month_mean",
    "cases_previous_3_month_sum", "cases_previous_6_month_sum",
    "cases_trend_1m", "cases_trend_3m",
]


def checked_month(month: str = "month") -> Column:
    """The month, or a runtime error outside 1 to 12."""
    value = F.col(month).cast("int")
    return F.when(value.between(1, 12), value).otherwise(
        F.raise_error(F.lit("month must be between 1 and 12.")).cast("int")
    )


def scoring_inputs(inputs: DataFrame, **climate_options) -> DataFrame:
    """Normalised keys, checked month, fixed year, climate and season."""
    named = inputs.select(
        text.normalize_disease("disease").alias("disease"),
        text.normalize_name("department").alias("department"),
        text.normalize_name("municipality").alias("municipality"),
        checked_month().alias("month"),
        F.lit(presets.PREDICTION_YEAR).alias("year"),
    )
    return climate_features(named, **climate_options)


def score_with(model: TrainedModel, inputs: DataFrame, reference_compat: bool) -> DataFrame:
    """Predictions of one model for its share of the inputs."""
    features = model.features.apply(numeric_as_double(scoring_features(inputs, model.priors, reference_compat)))
    scored = predict_raw(features, model.pipeline, model.transform)
    cases = metrics.blend("_model", presets.BLENDS[model.blend], scored.columns)
    return scored.withColumn("_cases", cases).select(
        "disease", "month", "department", F.col("municipality").alias("city"),
        F.rint("_cases").cast("int").alias("estimated_cases"),
        F.rint("_cases").cast("int").alias("estimated_outbreak_proxy"),
        epi.outbreak_level("_cases").alias("outbreak_level"),
        F.lit(model.name).alias("model_used"), F.lit(model.blend).alias("blend_used"),
        "thermal_floor", *[round_even(c, 2).alias(c) for c in ECHOED_2],
        round_even("climate_risk_score", 4).alias("climate_risk_score"),
        "is_rainy_season", "is_vector_favorable",
        *[
            F.lit(float(model.validation[m])).alias(f"validation_{m}")
            for m in ("r2", "mae", "wape_pct")
        ],
    )


def predict(
    inputs: DataFrame, bundle: Bundle, reference_compat: bool = False
) -> DataFrame:
    """Score (disease, department, municipality, month) rows.

    Each row goes to its disease's model, else to the global one: one filter
    per model, and the parts are united.
    """
    # Computed once: every model reads its share of it, not the cases again.
    ready = materialize(scoring_inputs(inputs, reference_compat=reference_compat))
    own = list(bundle.by_disease)
    parts = [
        score_with(model, ready.filter(F.col("disease") == name), reference_compat)
        for name, model in bundle.by_disease.items()
    ]
    rest = ready.filter(~F.col("disease").isin(own)) if own else ready
    parts.append(score_with(bundle.overall, rest, reference_compat))
    return reduce(DataFrame.unionByName, parts)


def prediction_records(predictions: DataFrame) -> DataFrame:
    """Columns of the published prediction table."""
    return predictions.select(*presets.PREDICTION_COLUMNS)


def publish(
    cases: DataFrame, bundle: Bundle, out_path: str, audit_path: str,
    current: DataFrame | None = None, reference_compat: bool = False,
) -> DataFrame:
    """Score every disease-place-month, merge into the published table, audit."""
    records = prediction_records(
        predict(scoring_scaffold(cases), bundle, reference_compat)
    )
    published = Observation("published")
    counted = records.observe(published, F.count(F.lit(1)).alias("rows"))
    table = sinks.upsert_table(current, counted, out_path, presets.PREDICTION_KEY)
    sinks.append_audit(
        sinks.audit_row(
            cases.sparkSession, "ml_predictions_random_forest", 0, 0, published.get["rows"]
        ),
        audit_path,
    )
    return table
