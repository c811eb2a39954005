"""Align source files with free headers to one canonical schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from casewatch import presets
from casewatch.functions.text import normalize_header
from casewatch.session import materialize


class MissingColumnsError(ValueError):
    """The frame lacks columns the operator needs."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {', '.join(missing)}")
    return df


def final_names(
    headers: list[str], aliases: Mapping[str, list[str]] = presets.HEADER_ALIASES
) -> list[str]:
    """Name of every column, by position, after alias matching.

    A canonical name goes to the first matching header. Of headers that
    normalise alike, the last one stands for all of them.
    """
    holder: dict[str, int] = {}
    for position, header in enumerate(headers):
        holder[normalize_header(header)] = position
    names = list(headers)
    for canonical, accepted in aliases.items():
        match = next((p for h, p in holder.items() if h in accepted), None)
        if match is not None:
            names[match] = canonical
    return names


def collapse_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """First non-null value per row of the columns that share a name.

    ``df`` is addressed by position, as ``names`` may repeat.
    """
    groups: dict[str, list[Column]] = {}
    for position, name in enumerate(names):
        groups.setdefault(name, []).append(F.col(f"_{position}"))
    return {name: F.coalesce(*columns) for name, columns in groups.items()}


def align(
    df: DataFrame,
    aliases: Mapping[str, list[str]] = presets.HEADER_ALIASES,
    canonical: list[str] = presets.CANONICAL_COLUMNS,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Rename by alias, collapse repeats, add missing columns, fix the order.

    Metadata only: one projection, no job. ``keep`` names further columns (row
    order, say) that pass through.
    """
    kept = [c for c in keep if c not in canonical]
    names = final_names(df.columns, aliases)
    values = collapse_columns(df, names)
    by_position = df.toDF(*[f"_{i}" for i in range(len(names))])
    absent = F.lit(None).cast("string")
    return by_position.select(
        *[values.get(c, absent).alias(c) for c in canonical],
        *[values[c].alias(c) for c in kept],
    )


def fill_empty_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Default for a column only where every row of the source lacks it.

    The test is one scalar subquery over the named columns, evaluated within
    the same query.
    """
    counts = df.agg(F.struct(*[F.count(c).alias(c) for c in defaults]).alias("n")).scalar()
    return df.select(*[
        F.when(counts.getField(c) == 0, F.lit(defaults[c]).cast(df.schema[c].dataType))
        .otherwise(F.col(c)).alias(c)
        if c in defaults else F.col(c)
        for c in df.columns
    ])


def align_source(
    df: DataFrame,
    disease: str,
    event_code: int,
    year: int,
    source: str,
    filename: str,
    keep: Iterable[str] = (),
    fill: bool = True,
) -> DataFrame:
    """One source in the canonical schema with lineage and source-wide defaults.

    With ``fill`` one query more looks whether a column the header has is empty
    throughout; ``union_filled`` does it for many sources in the pass that stages them.
    """
    present = set(final_names(df.columns))
    defaults = source_defaults(disease, event_code, year)
    aligned = align(df, keep=keep)
    # A column the header lacks is empty for sure: no need to read the source.
    absent = {c: v for c, v in defaults.items() if c not in present}
    aligned = aligned.withColumns({c: F.lit(v) for c, v in absent.items()})
    unsure = {c: v for c, v in defaults.items() if c in present}
    if unsure and fill:
        aligned = fill_empty_columns(aligned, unsure)
    return aligned.withColumns({
        "enfermedad": F.lit(disease),
        "source_name": F.lit(source),
        "source_file": F.lit(filename),
    })


def source_defaults(disease: str, event_code: int, year: int) -> dict[str, str]:
    """What a source that says nothing itself is known to hold."""
    return {"COD_EVE": str(event_code), "ANO": str(year), "Nombre_evento": disease}


def union_filled(
    frames: list[tuple[DataFrame, Mapping[str, str]]], each: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Aligned sources in one staged table; a column no row of a source has takes its default.

    Sources are read once: values are counted per source and column while the rows are
    written, and the counts decide what readers of the table see. ``each`` is a row by row
    step, column by column as far as columns with defaults go: rows are staged behind it, so that it
    takes no pass of its own, and defaults go through it as the rows do.
    """
    tag = "_source"
    whole = union_sources(df.withColumn(tag, F.lit(i)) for i, (df, _) in enumerate(frames))
    seen = Observation("values per source")
    counts = [
        F.count_if((F.col(tag) == i) & F.col(c).isNotNull()).alias(f"{i} {c}")
        for i, (_, defaults) in enumerate(frames) for c in defaults
    ]
    staged = materialize(each(whole.observe(seen, *counts)))
    empty: dict[str, list[tuple[int, object]]] = {}
    for i, (_, defaults) in enumerate(frames):
        lacking = {c: v for c, v in defaults.items() if not seen.get[f"{i} {c}"]}
        if lacking:
            row = staged.sparkSession.range(1).select(*[F.lit(lacking.get(f.name)).cast(f.dataType).alias(f.name) for f in whole.schema])
            for c, value in each(row).select(*lacking).first().asDict().items():
                empty.setdefault(c, []).append((i, value))
    filled = staged
    for c, sources in empty.items():
        value = F.col(c)
        for i, default in sources:
            value = F.when(F.col(tag) == i, F.lit(default).cast(staged.schema[c].dataType)).otherwise(value)
        filled = filled.withColumn(c, value)
    return filled.drop(tag)


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    if not frames:
        raise FileNotFoundError("none of the configured sources exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
