"""Column profiles for exploration: describe, correlations, box statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from casewatch.session import materialize

QUARTILES = [0.25, 0.5, 0.75]
CELLS = 2**16


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value) pairs with their counts; nulls left out."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ])
    return (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def ordered_code(value: Column) -> Column:
    """64-bit integer of a double that orders as the double does (NaN last)."""
    bits = F.call_function(
        "java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], cells: int = CELLS
) -> DataFrame:
    """Exact linear-interpolation quantiles of columns: (column, probability, value)."""
    return counted_quantiles(_long_values(df, columns), probabilities, cells)


def counted_quantiles(
    counted: DataFrame, probabilities: list[float], cells: int = CELLS
) -> DataFrame:
    """Exact quantiles of (column, value, n) rows; ``column`` may be any grouping key.

    ``percentile`` keeps every distinct value of a column in one task. Here equal
    values are counted first, so a frequent value is one row, and ranks are selected
    by digits: values are integers of 64 bits in the order of the doubles. A round
    counts the next ``cells`` (a power of two) digits below each cell that holds a
    wanted rank; only these cells go on, until the digits are used up. So no task
    ever ranks more than ``cells`` rows, whatever the number of values, and no value
    is approximated.
    """
    bits = cells.bit_length() - 1
    if cells != 1 << bits or bits < 1:
        raise ValueError("cells is a power of two")
    coded = materialize(counted.select("column", "value", "n", ordered_code(F.col("value")).alias("code")))
    wanted = F.array(*[F.struct(F.lit(p).alias("probability"), (F.lit(p) * (F.col("rows") - 1)).alias("rank")) for p in probabilities])
    ranks = coded.groupBy("column").agg(F.sum("n").alias("rows")).select("column", F.inline(wanted))
    ends = F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("place")
    # One row per column and wanted place: the cell it is in, and the rows before that cell.
    open_ = materialize(ranks.select("column", ends).distinct().select("column", "place", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before")))
    known = 64
    while known:
        left = max(0, known - bits)
        first_round = known == 64
        # The first round has one cell, all values.
        inside = coded if first_round else coded.withColumn("cell", F.shiftright("code", known)).join(
            open_.select("column", "cell").distinct(), ["column", "cell"], "left_semi")
        digits = inside.groupBy("column", F.shiftright("code", left).alias("next")).agg(F.sum("n").alias("n"), F.max("value").alias("value"))
        above = F.lit(0).cast("long") if first_round else F.shiftright("next", known - left)
        known = left
        run = W.partitionBy("column", "cell").orderBy("next").rowsBetween(W.unboundedPreceding, -1)
        placed = digits.withColumn("cell", above).withColumn("earlier", F.coalesce(F.sum("n").over(run), F.lit(0)))
        first = F.col("before") + F.col("earlier")
        found = placed.join(open_.select("column", "place", "cell", "before"), ["column", "cell"]).filter((F.col("place") >= first) & (F.col("place") < first + F.col("n")))
        open_ = materialize(found.select("column", "place", F.col("next").alias("cell"), first.alias("before"), "value"))
    low = open_.select("column", F.col("place").alias("_low"), F.col("value").alias("a"))
    high = open_.select("column", F.col("place").alias("_high"), F.col("value").alias("b"))
    both = ranks.withColumns({"_low": F.floor("rank"), "_high": F.ceil("rank")}).join(low, ["column", "_low"]).join(high, ["column", "_high"])
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.col("_low"))
    return both.select("column", "probability", value.alias("value"))


def _is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def describe(df: DataFrame) -> DataFrame:
    """Count, unique, top, frequency, mean, deviation, extremes and quartiles.

    One row per column. Numeric columns get moments and quartiles, the others
    distinct count and most frequent value (ties: smallest value).
    """
    numeric = [f.name for f in df.schema.fields if _is_numeric(f)]
    other = [f.name for f in df.schema.fields if not _is_numeric(f)]
    empty = {
        "unique": "bigint", "top": "string", "freq": "bigint", "mean": "double",
        "std": "double", "min": "double", "q25": "double", "q50": "double",
        "q75": "double", "max": "double",
    }
    order = ["column", "count", *empty]

    def shaped(part: DataFrame) -> DataFrame:
        lacking = {k: F.lit(None).cast(v) for k, v in empty.items() if k not in part.columns}
        return part.withColumns(lacking).select(*order)

    parts = []
    if numeric:
        moments = df.agg(F.array(*[
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("count"),
                F.avg(c).alias("mean"), F.stddev(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ) for c in numeric
        ]).alias("_all")).select(F.inline("_all"))
        quartiles = exact_quantiles(df, numeric, QUARTILES).groupBy("column").agg(*[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(f"q{int(p * 100)}")
            for p in QUARTILES
        ])
        parts.append(shaped(moments.join(quartiles, "column", "left")))
    if other:
        pairs = F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in other
        ])
        values = df.select(F.inline(pairs)).groupBy("column", "value").agg(
            F.count("value").alias("n")
        )
        # (-n, value) orders by frequency, then by value; nulls are not values.
        best = F.min(F.when(
            F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value"))
        ))
        parts.append(shaped(values.groupBy("column").agg(
            F.sum("n").alias("count"), F.count("value").alias("unique"), best.alias("_best")
        ).select(
            "column", "count", "unique", F.col("_best.value").alias("top"),
            (-F.col("_best.n")).alias("freq"),
        )))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present.

    All pairs are aggregates of one pass; columns the frame lacks are skipped.
    """
    present = [c for c in columns if c in df.columns]
    cells = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr"),
        )
        for a in present for b in present if a <= b
    ]
    half = df.agg(F.array(*cells).alias("_all")).select(F.inline("_all"))
    mirrored = half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return half.unionByName(mirrored)


def box_stats(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR, clipped to data) and outlier count per group.

    Equal values of a group are counted first and ranked in cells, so no group
    meets in one task.
    """
    counted = materialize(df.filter(F.col(measure).isNotNull()).groupBy(
        F.col(group).alias("column"), F.col(measure).cast("double").alias("value")
    ).agg(F.count(F.lit(1)).alias("n")))
    points = counted_quantiles(counted, QUARTILES).groupBy("column").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
        for p, name in zip(QUARTILES, ("q1", "median", "q3"), strict=True)
    ])
    sizes = counted.groupBy("column").agg(F.sum("n").alias("n"))
    quartiles = sizes.join(points, "column").withColumnRenamed("column", group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(measure).between(F.col("q1") - reach, F.col("q3") + reach)
    return df.join(quartiles, group).groupBy(group, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(measure))).alias("whisker_low"),
        F.max(F.when(inside, F.col(measure))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
