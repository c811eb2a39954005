"""Regression metrics, blends, model selection score and the stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casewatch import presets
from casewatch.functions.numbers import round_even, safe_ratio
from casewatch.operators.profile import exact_quantiles

METRICS = ["mae", "rmse", "r2", "mape_non_zero_pct", "wape_pct", "smape_pct"]
CELL_ROWS = 1000


def regression_metrics(truth: str | Column, prediction: str | Column) -> dict[str, Column]:
    """The six metrics as aggregates; predictions below zero count as zero."""
    y = (F.col(truth) if isinstance(truth, str) else truth).cast("double")
    raw = F.col(prediction) if isinstance(prediction, str) else prediction
    guess = F.greatest(raw.cast("double"), F.lit(0.0))
    gap = F.abs(y - guess)
    middle = (F.abs(y) + F.abs(guess)) / 2
    spread = F.var_pop(y) * F.count(y)
    residual = F.sum(gap * gap)
    r2 = F.when(spread > 0, 1 - safe_ratio(residual, spread)).when(
        residual == 0, F.lit(1.0)
    ).otherwise(F.lit(0.0))
    values = {
        "mae": F.avg(gap),
        "rmse": F.sqrt(F.avg(gap * gap)),
        "r2": r2,
        "mape_non_zero_pct": F.coalesce(F.avg(F.when(y > 0, gap / F.nullif(y, F.lit(0.0)))), F.lit(0.0)) * 100,
        "wape_pct": F.coalesce(safe_ratio(F.sum(gap), F.sum(F.abs(y))), F.lit(0.0)) * 100,
        "smape_pct": F.avg(gap / F.when(middle == 0, F.lit(1.0)).otherwise(middle)) * 100,
    }
    return {name: round_even(value, 4) for name, value in values.items()}


def evaluate(df: DataFrame, truth: str, prediction: str, *by: str) -> DataFrame:
    metrics = regression_metrics(truth, prediction)
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in metrics.items()])


def blend(
    model: str | Column, weights: dict[str, float], available: list[str] | None = None
) -> Column:
    """Weighted mean of the model and named priors, never below zero.

    A component the frame lacks (per ``available``) counts as zero.
    """
    raw = F.col(model) if isinstance(model, str) else model
    total = sum(weights.values())
    if total <= 0:
        return F.greatest(raw, F.lit(0.0))
    mixed = F.lit(0.0)
    for component, weight in weights.items():
        if component == "model":
            value = raw
        elif available is None or component in available:
            value = F.col(component).cast("double")
        else:
            value = F.lit(0.0)
        mixed = mixed + value * F.lit(weight)
    return F.greatest(mixed / F.lit(total), F.lit(0.0))


def blend_scores(
    df: DataFrame, truth: str, model: str, blends: dict[str, dict] = presets.BLENDS
) -> DataFrame:
    """Metrics and selection score of every blend, in one grouped aggregate."""
    guesses = F.array(*[
        F.struct(
            F.lit(order).alias("blend_order"), F.lit(name).alias("blend"),
            blend(model, weights, df.columns).alias("_guess"),
        )
        for order, (name, weights) in enumerate(blends.items())
    ])
    each = df.select(F.col(truth).alias("_truth"), F.inline(guesses))
    scored = evaluate(each, "_truth", "_guess", "blend_order", "blend")
    return scored.withColumn("score", selection_score())


def selection_score() -> Column:
    score = F.lit(0.0)
    for name, weight in presets.SELECTION_WEIGHTS.items():
        score = score + F.col(name) * F.lit(weight)
    return score


def target_bins(
    df: DataFrame, target: str = presets.TARGET, bins: int = presets.TARGET_BINS
) -> DataFrame:
    """Quantile bin of ``log1p(target)``; equal cut points merge.

    The bin number counts the inner cut points below the value, which makes
    the bins right-closed. The cut points, at most ``bins`` numbers, are
    computed first and enter the plan as literals.
    """
    y = F.log1p(F.col(target).cast("double"))
    points = [i / bins for i in range(bins)]
    found = exact_quantiles(df.select(y.alias("y")), ["y"], points).select("value").collect()
    edges = sorted({row["value"] for row in found})[1:]  # the minimum cuts nothing
    number = F.lit(0)
    for edge in edges:
        number = number + (y > edge).cast("int")
    return df.withColumn("bin", number)


def stratified_split(
    df: DataFrame,
    key: list[str],
    target: str = presets.TARGET,
    test_share: float = presets.TEST_SHARE,
    bins: int = presets.TARGET_BINS,
    seed: int = presets.SEED,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add ``is_test``: an exact share of every target bin, those with the smallest key hash.

    The hash is the MD5 text of the key and the seed, joined by ``|``, nulls left out, so
    any engine draws the same rows. Ranking a whole bin in one window would put a
    fifth of all rows into one task, so the hash range is cut into successive cells of about
    ``cell_rows`` rows: rows are ranked within (bin, cell), and the counts of the
    cells before it supply the offset. When a bin holds a single row, bins
    are given up and the split is plain, as in the reference.
    """
    binned = target_bins(df, target, bins)
    hashed = binned.withColumn("_hash", F.md5(F.concat_ws("|", *key, F.lit(str(seed))).cast("binary")))
    # One row per bin.
    smallest, rows = binned.groupBy("bin").count().agg(F.min("count"), F.sum("count")).head()
    cells = max(1, (rows or 0) // cell_rows)
    # The first 32 of the 128 bits, scaled to the number of cells.
    lead = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    celled = hashed.withColumn("_cell", F.floor(lead * F.lit(cells) / F.lit(2**32)))
    if smallest is None or smallest < 2:
        celled = celled.withColumn("bin", F.lit(0))
    sizes = celled.groupBy("bin", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("bin").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("bin")
    offsets = sizes.select(
        "bin", "_cell",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    inside = F.row_number().over(W.partitionBy("bin", "_cell").orderBy("_hash", *key))
    ranked = celled.withColumn("_inside", inside).join(offsets, ["bin", "_cell"])
    limit = F.rint(F.col("_size") * F.lit(test_share))
    return ranked.withColumn(
        "is_test", F.col("_before") + F.col("_inside") <= limit
    ).drop("_hash", "_cell", "_inside", "_before", "_size")
