"""Quality report and null profile in one pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _null_count(name: str) -> Column:
    return F.count_if(F.col(f"`{name}`").isNull())


def quality_report(
    flagged: DataFrame,
    columns: list[str],
    copies: str | None = None,
    weekly: DataFrame | None = None,
    disease: str = "enfermedad",
) -> DataFrame:
    """Long (metric, value) report over deduplicated, flagged case rows.

    ``flagged`` carries ``is_rejected``. One aggregate per (rejected, disease)
    holds every null count; its few rows are then unfolded and summed. With
    ``copies`` the removed duplicates are reported, with ``weekly`` the
    aggregate rows.
    """
    rejected = F.col("is_rejected")
    measures = {f"nulls_{c}": _null_count(c) for c in columns}
    removed = F.sum(F.col(copies) - 1) if copies else F.lit(0)
    grouped = flagged.groupBy(rejected.alias("_rejected"), F.col(disease).alias("_disease")).agg(
        F.count(F.lit(1)).alias("_rows"), removed.alias("_removed"),
        *[value.alias(name) for name, value in measures.items()],
    )

    def entry(name: Column | str, value: Column) -> Column:
        metric = F.lit(name) if isinstance(name, str) else name
        return F.struct(metric.alias("metric"), value.cast("long").alias("value"))

    def if_valid(value: Column) -> Column:
        return F.when(F.col("_rejected"), 0).otherwise(value)

    fixed = [
        ("total_clean_rows", if_valid(F.col("_rows"))),
        ("total_rejected_rows", F.when(F.col("_rejected"), F.col("_rows")).otherwise(0)),
        *[(name, if_valid(F.col(f"`{name}`"))) for name in measures],
    ]
    if copies:
        fixed.append(("duplicates_removed", F.col("_removed")))
    per_disease = F.when(
        ~F.col("_rejected"),
        entry(F.concat(F.lit("rows_disease_"), F.col("_disease")), F.col("_rows")),
    )
    rows = grouped.select(F.inline(F.array_compact(
        F.array(*[entry(name, value) for name, value in fixed], per_disease)
    )))
    # One zero row per fixed metric, so that an empty input still reports them.
    zeros = flagged.sparkSession.range(1).select(
        F.inline(F.array(*[entry(name, F.lit(0)) for name, _ in fixed]))
    )
    parts = [rows, zeros]
    if weekly is not None:
        parts.append(weekly.agg(
            F.lit("total_aggregated_rows").alias("metric"), F.count(F.lit(1)).alias("value")
        ))
    return reduce(DataFrame.unionByName, parts).groupBy("metric").agg(
        F.sum("value").alias("value")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percentage, most first; one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[_null_count(c).alias(c) for c in df.columns]
    )
    unfolded = counts.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns
    ])))
    percent = F.rint(F.col("nulls") * 10000.0 / F.col("_rows")) / 100
    return (
        unfolded.filter("nulls > 0")
        .select("column", "nulls", percent.alias("pct"))
        .orderBy(F.desc("pct"), "column")
    )
