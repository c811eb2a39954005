"""Historical means at ten grains, their lookup chain, and inference lags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casewatch import presets
from casewatch.functions.numbers import safe_ratio
from casewatch.operators.windows import ENTITY
from casewatch.session import materialize

MONTHS = range(1, 13)
# Coarser grains than the entity itself, each a subset of its keys.
GRAINS = {
    "dept": ["department"],
    "muni": ["department", "municipality"],
    "disease": ["disease"],
    "disease_dept": ["disease", "department"],
}


def _roll_up(base: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Mean and twelve monthly means (null for a month never seen) per key."""
    totals = base.groupBy(*keys).agg(*[
        F.sum(f"{kind}{m}").alias(f"{kind}{m}") for m in MONTHS for kind in ("s", "n")
    ])
    return _means(totals, keys, prefix)


def _means(totals: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    def add(kind: str) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"{kind}{m}") for m in MONTHS])

    by_month = F.array(*[safe_ratio(F.col(f"s{m}"), F.col(f"n{m}")) for m in MONTHS])
    return totals.select(
        *keys,
        safe_ratio(add("s"), add("n")).alias(f"{prefix}_mean"),
        by_month.alias(f"{prefix}_months"),
    )


@dataclass(frozen=True)
class Priors:
    """Sums (``s1``..``s12``) and row counts (``n1``..``n12``) per entity.

    Every grain is a roll-up of this one table, whose size is the number of
    disease-places, whatever the number of cases or years.
    """

    base: DataFrame

    @staticmethod
    def fit(panel: DataFrame, target: str = presets.TARGET) -> Priors:
        """One pass over the panel: a fixed-width hash aggregate per entity."""
        sums = [
            F.coalesce(F.sum(F.when(F.col("month") == m, F.col(target))), F.lit(0.0))
            .cast("double").alias(f"s{m}")
            for m in MONTHS
        ]
        counts = [F.count_if(F.col("month") == m).alias(f"n{m}") for m in MONTHS]
        return Priors(panel.groupBy(*ENTITY).agg(*sums, *counts))

    def stored(self) -> Priors:
        """The same priors over a written base table.

        The base is small and read once per grain, so its computation should
        not be part of every plan that applies it.
        """
        return Priors(materialize(self.base))

    def grain(self, keys: list[str], prefix: str) -> DataFrame:
        return _roll_up(self.base, keys, prefix)

    def entity(self) -> DataFrame:
        return _means(self.base, ENTITY, "entity")

    def national(self) -> Column:
        """Overall mean and monthly means, as a one-row scalar subquery."""
        whole = _roll_up(self.base, [], "all")
        return whole.select(F.struct("all_mean", "all_months")).scalar()

    def resolve(self, entities: DataFrame) -> DataFrame:
        """All grains next to each entity key, seen before or not.

        The lookups run on distinct entities, not on panel rows. Their sizes
        depend on the data, so no broadcast is forced: adaptive execution
        picks it where the measured size allows.
        """
        resolved = entities.join(self.entity(), ENTITY, "left")
        for prefix, keys in GRAINS.items():
            resolved = resolved.join(self.grain(keys, prefix), keys, "left")
        return resolved.withColumn("_all", self.national()).select(
            "*", "_all.all_mean", "_all.all_months"
        ).drop("_all")


def _month_of(prefix: str, month: str = "month") -> Column:
    return F.element_at(F.col(f"{prefix}_months"), F.col(month))


def _zero_mean(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def prior_columns() -> dict[str, Column]:
    """The ten priors over resolved columns; each falls back to a coarser one."""
    overall = _zero_mean(F.col("all_mean"))
    dept = F.coalesce("dept_mean", overall)
    muni = F.coalesce("muni_mean", dept)
    disease_dept = F.coalesce("disease_dept_mean", dept)
    disease_muni = F.coalesce("entity_mean", muni)
    return {
        "department_global_mean_cases": dept,
        "municipality_global_mean_cases": muni,
        "department_month_mean_cases": F.coalesce(_month_of("dept"), dept),
        "municipality_month_mean_cases": F.coalesce(_month_of("muni"), muni),
        "department_disease_mean_cases": disease_dept,
        "municipality_disease_mean_cases": disease_muni,
        "department_disease_month_mean_cases": F.coalesce(
            _month_of("disease_dept"), disease_dept
        ),
        "municipality_disease_month_mean_cases": F.coalesce(
            _month_of("entity"), disease_muni
        ),
        "disease_month_mean_cases": F.coalesce(_month_of("disease"), overall),
        "national_month_mean_cases": F.coalesce(_month_of("all"), overall),
    }


def _with_prior_columns(resolved: DataFrame) -> DataFrame:
    share = safe_ratio(
        F.col("municipality_month_mean_cases"), F.col("department_month_mean_cases")
    )
    clipped = F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(10.0))
    return resolved.withColumns(prior_columns()).withColumn(
        "municipality_share_in_department_month", clipped
    )


def _drop_resolved(df: DataFrame) -> DataFrame:
    prefixes = ["entity", "all", *GRAINS]
    return df.drop(*[f"{p}_{kind}" for p in prefixes for kind in ("mean", "months")])


def apply_priors(df: DataFrame, priors: Priors) -> DataFrame:
    """Prior features for every row; one join on the entity keys."""
    resolved = priors.resolve(df.select(*ENTITY).distinct())
    return _drop_resolved(_with_prior_columns(df.join(resolved, ENTITY, "left")))


def lag_month(month: Column, back: int, reference_compat: bool) -> Column:
    """Calendar month ``back`` months earlier.

    ``reference_compat`` clamps every month before January to December.
    """
    if reference_compat:
        return F.when(month - back < 1, 12).otherwise(month - back)
    return F.pmod(month - back - 1, F.lit(12)) + 1


def inference_lags(resolved: DataFrame, reference_compat: bool = False) -> DataFrame:
    """Lags one to six from the entity's monthly means.

    A month never seen takes the previous lag; before that the municipality's
    mean, then the overall one.
    """
    fallback = F.coalesce("muni_mean", "all_mean", F.lit(0.0))
    for back in range(1, 7):
        month = lag_month(F.col("month"), back, reference_compat).cast("int")
        seen = F.element_at(F.col("entity_months"), month)
        resolved = resolved.withColumn(f"lag_{back}", F.coalesce(seen, fallback))
        fallback = F.col(f"lag_{back}")
    return resolved


def lag_features(df: DataFrame) -> DataFrame:
    """History features of a scoring row from its six lags."""
    lag = {k: F.col(f"lag_{k}") for k in range(1, 7)}

    def total(k: int) -> Column:
        return reduce(lambda a, b: a + b, [lag[i] for i in range(1, k + 1)])

    return df.withColumns({
        "cases_previous_month": lag[1],
        "cases_previous_2_month_mean": total(2) / 2,
        "cases_previous_3_month_mean": total(3) / 3,
        "cases_previous_6_month_mean": total(6) / 6,
        "cases_previous_3_month_sum": total(3),
        "cases_previous_6_month_sum": total(6),
        "cases_trend_1m": lag[1] - lag[2],
        "cases_trend_3m": total(3) / 3 - total(6) / 6,
    }).drop(*[f"lag_{k}" for k in range(1, 7)])


def scoring_features(
    inputs: DataFrame, priors: Priors, reference_compat: bool = False
) -> DataFrame:
    """Lag and prior features of scoring inputs; lookups run once per entity."""
    resolved = priors.resolve(inputs.select(*ENTITY).distinct())
    joined = inputs.join(resolved, ENTITY, "left")
    lagged = lag_features(inference_lags(joined, reference_compat))
    return _drop_resolved(_with_prior_columns(lagged))
