"""Model inputs from a fitted feature table: category numbers, modes and exact medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window as W

from casewatch.operators.profile import exact_quantiles
from casewatch.session import materialize


@dataclass
class FeatureTable:
    """Fitted features: a table that rows are joined with, and a few numbers per column.

    ``table`` has a row per category (column, value, number, mode) and one per numeric
    column (column, median). Names of categories stay in it; the driver holds one mode,
    median or width a column.
    """

    table: DataFrame
    modes: dict[str, str]
    medians: dict[str, float]
    widths: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, categorical: list[str], numeric: list[str]) -> FeatureTable:
        """Numbers by frequency (ties: smaller value first), modes, exact medians (null without values)."""
        parts = []
        if categorical:
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical])
            counted = df.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            order = W.partitionBy("column").orderBy(F.desc("n"), "value")
            numbered = counted.select("column", "value", (F.row_number().over(order) - 1).alias("number"), F.first("value").over(order).alias("mode"))
            parts.append(numbered.withColumn("median", F.lit(None).cast("double")))
        if numeric:
            found = exact_quantiles(df, numeric, [0.5]).select("column", F.col("value").alias("median"))
            named = df.sparkSession.createDataFrame([(c,) for c in numeric], "column string").join(found, "column", "left")
            parts.append(named.select(
                "column", F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("mode"), "median"))
        return cls.of(materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])))

    @classmethod
    def of(cls, table: DataFrame) -> FeatureTable:
        """From a stored table: one row a column comes to the driver."""
        rows = table.groupBy("column").agg(F.max("mode").alias("mode"), F.max("median").alias("median"), F.max("number").alias("last")).collect()
        known = {r["column"]: r for r in rows}
        categorical = [c for c, r in known.items() if r["last"] is not None]
        return cls(
            table, {c: known[c]["mode"] for c in categorical},
            {c: r["median"] or 0.0 for c, r in known.items() if c not in categorical},
            {c: known[c]["last"] + 1 for c in categorical})

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_idx_`` (number, the width for an unseen value) and ``_num_`` columns.

        Missing categories take the mode, missing numbers the median (0 where no value was seen).
        """
        out = df
        for c, mode in self.modes.items():
            own = self.table.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("number").alias(f"_idx_{c}"))
            out = out.join(own, F.coalesce(F.col(c).cast("string"), F.lit(mode)) == F.col("_value"), "left").drop("_value").withColumn(
                f"_idx_{c}", F.coalesce(f"_idx_{c}", F.lit(self.widths[c])).cast("double"))
        numbers = {c: F.col(c).cast("double") for c in self.medians}
        return out.withColumns({
            f"_num_{c}": F.coalesce(F.when(~F.isnan(value), value), F.lit(self.medians[c])) for c, value in numbers.items()
        })
