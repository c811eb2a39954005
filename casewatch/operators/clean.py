"""Typed, decoded and range-checked case rows; the reject split; row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casewatch import presets
from casewatch.functions import dates, epi, numbers, text


class NotFoundError(LookupError):
    """No row answers the query."""


def _as_int(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).try_cast("int")
    return numbers.to_int(name)


def _as_timestamp(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return dates.parse_date(name)


def clean_cases(df: DataFrame) -> DataFrame:
    """Clean aligned case rows: types, codes, text, ranges, derived columns.

    Projections only, no shuffle: it stays in one stage with the scan.
    """
    typed: dict[str, Column] = {name: F.col(name) for name in df.columns}
    for name in presets.DATE_COLUMNS:
        typed[name] = _as_timestamp(df, name)
    for name in presets.INTEGER_COLUMNS + ["estrato"]:
        typed[name] = _as_int(df, name)
    for name in presets.CODE_WIDTHS:
        typed[name] = text.code_digits(F.col(name).cast("string"))
    for name in presets.TEXT_COLUMNS:
        typed[name] = F.col(name).cast("string")
    named = text.normalize_text_columns(
        df.select(*[value.alias(name) for name, value in typed.items()]),
        presets.TEXT_COLUMNS,
    )
    base = named.withColumns({
        **{name: text.pad_code(name, width) for name, width in presets.CODE_WIDTHS.items()},
        "SEXO": epi.recode_sex("SEXO"),
        "estrato": numbers.within("estrato", presets.STRATUM_RANGE),
        "SEMANA": numbers.within("SEMANA", presets.WEEK_RANGE),
        "ANO": numbers.within("ANO", presets.YEAR_RANGE),
    })

    counted = base.withColumn("confirmados", epi.confirmed_flag("confirmados", "nom_est_f_caso", "TIP_CAS"))
    return with_derived(counted).na.fill(presets.NO_DATA, presets.FILLED_COLUMNS)


def with_derived(df: DataFrame) -> DataFrame:
    """Add the derived columns; each is a function of cleaned columns of its row."""
    derived = {
        "edad_anos": epi.age_in_years("EDAD", "UNI_MED"),
        "tipo_caso": epi.decode("TIP_CAS", presets.CASE_TYPES),
        "condicion_final": epi.decode("CON_FIN", presets.FINAL_CONDITIONS),
        "hospitalizado": epi.decode("PAC_HOS", presets.HOSPITAL_STATUS),
        "area_residencia": epi.decode("AREA", presets.RESIDENCE_AREAS),
        "unidad_edad": epi.decode("UNI_MED", presets.AGE_UNITS),
        "regimen_salud": epi.decode_insurance("TIP_SS"),
        "dias_notificacion": dates.delay_days("FEC_NOT", "INI_SIN"),
    }
    return df.withColumns(derived).withColumn("grupo_etario", epi.age_group("edad_anos"))


REQUIRED = {
    "ANO": "year", "SEMANA": "week", "enfermedad": "disease",
    "Departamento_ocurrencia": "department",
}


def flag_rejected(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (the lacking fields) and ``is_rejected``."""
    reasons = [
        F.when(F.coalesce(F.col(name) == presets.NO_DATA, F.lit(True)), F.lit(label))
        if name == "Departamento_ocurrencia"
        else F.when(F.col(name).isNull(), F.lit(label))
        for name, label in REQUIRED.items()
    ]
    flagged = df.withColumn("reject_reason", F.array_compact(F.array(*reasons)))
    return flagged.withColumn("is_rejected", F.size("reject_reason") > 0)


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of one frame; together they are all its rows."""
    flagged = flag_rejected(df)
    valid = flagged.filter(~F.col("is_rejected")).drop("is_rejected", "reject_reason")
    return valid, flagged.filter("is_rejected").drop("is_rejected")


def where_equals(df: DataFrame, **wanted: str | int | None) -> DataFrame:
    """Equality filters; text compares case-insensitively, ``None`` is no filter."""
    for name, value in wanted.items():
        if isinstance(value, str):
            df = df.filter(text.same_text(name, value))
        elif value is not None:
            df = df.filter(F.col(name) == value)
    return df


def known_places(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose place columns are neither null nor the sentinel."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull() & (F.col(name) != presets.NO_DATA))
    return df


def known_sex(df: DataFrame, column: str = "SEXO") -> DataFrame:
    return df.filter(F.col(column).isin("M", "F"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or an error when it has no row (runs a one-row job)."""
    if df.isEmpty():
        raise NotFoundError(message)
    return df


def find_prediction(
    predictions: DataFrame, disease: str, month: int, department: str, city: str
) -> DataFrame:
    """One published prediction by its key, or ``NotFoundError``.

    The disease is matched without case, names without accents.
    """
    wanted = predictions.sparkSession.range(1).select(
        text.normalize_name(F.lit(department)).alias("department"),
        text.normalize_name(F.lit(city)).alias("city"),
    )
    hit = predictions.filter(text.same_text("disease", disease) & (F.col("month") == month))
    found = hit.join(F.broadcast(wanted), ["department", "city"], "left_semi").select(
        *predictions.columns
    )
    return require_rows(found, f"no prediction for {disease} in {city}, month {month}")
