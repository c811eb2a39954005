"""Case deduplication and keyed upsert."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casewatch import presets


def dedupe_cases(
    df: DataFrame,
    keys: tuple[str, ...] = ("enfermedad", "CONSECUTIVE", "COD_EVE"),
    id_column: str = "CONSECUTIVE",
    order_by: list[str] | None = None,
    copies: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """First row per key; rows without an id lose exact duplicates only.

    Both rules run as one aggregate with one shuffle: a row without an id adds
    its whole content to the grouping key, a row with one adds null. Copies
    are reduced before the shuffle, so a key that holds a third of all rows
    costs no more than any other, and no window ever sorts it.

    ``order_by`` decides which copy is first (default: all columns) and is not
    part of a row's content. ``copies`` adds the number of merged rows.

    With one whole-number ``order_by`` column the aggregate holds numbers only and
    hashes: the smallest place per key and the row hash there. The rows they name are
    then fetched by a join; place and hash are computed where the rows arrive and do not
    travel with them. Rows without an id are whole in their grouping key, so they are
    neither shuffled again nor joined. Numbers of up to 18 digits may repeat: a place holds the row
    hash behind the number, so ties go to one of the rows that differ, the same in every
    run. Wider numbers, places of rows in files, should be unique; of a tie any one stays.
    A null number is the first. ``unique`` tells that no two rows have the same number: then the
    number alone names its row, content is neither hashed nor compared, and keys are read without it.
    """
    order = order_by or df.columns
    content = [c for c in df.columns if c not in (order_by or [])]
    has_id = F.col(id_column).isNotNull() & (F.col(id_column).cast("string") != presets.NO_DATA)
    whole_row = F.when(~has_id, F.struct(*content))
    groups_by = [*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], whole_row.alias("_content")]
    if len(order) == 1 and (place := row_place(df, order[0])) is not None:
        numbered = df.filter(has_id)
        if unique:
            first = numbered.select(*df.columns, place.alias("_place")).groupBy(*groups_by[:-1]).agg(
                F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_copies"))
            once = numbered.join(first.select("_place", "_copies"), place == F.col("_place"))
        else:
            own_hash = F.xxhash64(F.lit(1), *content)
            first = numbered.select(*df.columns, place.alias("_place"), own_hash.alias("_row")).groupBy(*groups_by[:-1]).agg(
                F.min("_place").alias("_place"), F.min_by("_row", "_place").alias("_row"), F.count(F.lit(1)).alias("_copies"))
            named = first.select("_place", "_row", "_copies")
            rows = numbered.join(named, (place == F.col("_place")) & (own_hash == F.col("_row")))
            # Rows equal in every column are found together; they hash into one.
            once = rows.select("_place", "_row", "_copies", *df.columns).distinct()
        # A null number is the first.
        first_number = F.when(F.count(order[0]) == F.count(F.lit(1)), F.min(order[0]))
        others = [c for c in df.columns if c != order[0]]
        plain = df.filter(~has_id).groupBy(*others, *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys) if k == order[0]]).agg(
            first_number.alias("_number"), F.count(F.lit(1)).alias("_copies"))
        whole = plain.select(*[F.col("_number").alias(c) if c == order[0] else F.col(c) for c in df.columns], "_copies")
        return once.select(*df.columns, "_copies").unionByName(whole).select(
            *df.columns, *([F.col("_copies").alias(copies)] if copies else []))
    grouped = df.groupBy(*groups_by).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first"),
        F.count(F.lit(1)).alias("_copies"),
    )
    kept = grouped.select("_first.*", *([F.col("_copies").alias(copies)] if copies else []))
    return kept


def row_place(df: DataFrame, column: str) -> Column | None:
    """Fixed-width place by a whole-number column, None for others; see ``dedupe_cases``."""
    kind = df.schema[column].dataType
    whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
    if not whole:
        return None
    if isinstance(kind, T.DecimalType) and kind.precision > 18:
        return F.coalesce(F.col(column), F.lit(Decimal(1 - 10**kind.precision)).cast(kind))
    number = F.coalesce(F.col(column).cast("decimal(19,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(19,0)"))
    row = F.xxhash64(*df.columns).bitwiseAND(F.lit(2**62 - 1)).cast("decimal(19,0)")
    return (number * F.lit(Decimal(2**62)).cast("decimal(19,0)") + row).cast("decimal(38,0)")


def count_removed(deduped: DataFrame, copies: str) -> DataFrame:
    """Rows before, rows after and rows removed, from the copy counts."""
    return deduped.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col(copies) - 1), F.lit(0)).alias("duplicates_removed"),
    )


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: list[str] = presets.PREDICTION_KEY,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Incoming rows replace current rows with the same key.

    With ``order_by`` the last incoming row per key wins; without it incoming
    keys must be unique.
    """
    if order_by:
        incoming = incoming.groupBy(*keys).agg(
            F.max_by(F.struct(*incoming.columns), F.struct(*order_by)).alias("_last")
        ).select("_last.*")
    same_key = [current[k].eqNullSafe(incoming[k]) for k in keys]
    untouched = current.join(incoming, on=same_key, how="left_anti")
    return untouched.unionByName(incoming, allowMissingColumns=True)
