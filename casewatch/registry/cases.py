"""Case-shaped view of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewatch import presets
from casewatch.functions import epi
from casewatch.operators.align import align
from casewatch.operators.panel import training_panel
from casewatch.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def case_view(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One case per order line; ``more`` names further columns of the tables.

    Join strategies are left to the optimizer.
    """
    line = table(spark, folder, "lineitem")
    order = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    joined = (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(customer, order.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    col = F.col
    case_id = F.concat_ws("-", col("l_orderkey").cast("string"), col("l_linenumber").cast("string"))
    week_date = col("l_shipdate").cast("date")
    return joined.select(
        F.when(col("l_linenumber") != 7, case_id).alias("CONSECUTIVE"),
        F.lit(210).alias("COD_EVE"),
        col("c_mktsegment").alias("enfermedad"),
        col("l_shipdate").alias("FEC_NOT"),
        col("o_orderdate").alias("INI_SIN"),
        F.weekofyear(week_date).alias("SEMANA"),
        F.extract(F.lit("YEAROFWEEK"), week_date).cast("int").alias("ANO"),
        col("l_quantity").cast("int").alias("EDAD"),
        (col("l_linenumber") % 5).cast("int").alias("UNI_MED"),
        F.when(col("l_returnflag") == "A", "F").when(col("l_returnflag") == "N", "M")
        .otherwise("SIN_DATO").alias("SEXO"),
        F.when(col("l_linenumber") % 4 == 0, "C").when(col("l_linenumber") % 4 == 1, "s ")
        .when(col("l_linenumber") % 4 == 2, "X").alias("TIP_SS"),
        (col("l_suppkey") % 6).cast("int").alias("TIP_CAS"),
        F.when(col("l_linestatus") == "F", 1).otherwise(2).alias("PAC_HOS"),
        F.when(col("o_orderstatus") == "F", 2).when(col("o_orderstatus") == "O", 1)
        .alias("CON_FIN"),
        (col("n_nationkey") % 4).cast("int").alias("AREA"),
        (col("c_custkey") % 9).cast("int").alias("estrato"),
        F.when(col("l_partkey") % 50 == 0, "SIN_DATO").otherwise(col("r_name"))
        .alias("Departamento_ocurrencia"),
        col("n_name").alias("Municipio_ocurrencia"),
        col("r_regionkey").cast("string").alias("COD_DPTO_O"),
        col("n_nationkey").cast("string").alias("COD_MUN_O"),
        F.when(col("l_discount") > 0.085, "Confirmado por laboratorio")
        .otherwise("Descartado").alias("nom_est_f_caso"),
        *more,
    )


def ordered_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The view with a number per row, as a source scan gives it."""
    view = case_view(spark, folder, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    place = F.col("l_orderkey").cast("decimal(19,0)") * 8 + F.col("l_linenumber")
    for part in ("l_partkey", "l_suppkey", "l_quantity"):
        place = (place.cast("decimal(38,0)") * 1_000_000).cast("decimal(38,0)") + F.col(part).cast("decimal(19,0)")
    return view.withColumn("row_place", place.cast("decimal(38,0)")).drop(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def raw_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The view as raw files hold it: unknown weeks, impossible years, rows sent twice."""
    view = case_view(spark, folder, "l_partkey", "l_suppkey")
    once = view.withColumns({
        "CONSECUTIVE": F.concat("CONSECUTIVE", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey"),
        "SEMANA": F.when(F.col("l_partkey") % 97 != 0, F.col("SEMANA")),
        "ANO": F.when(F.col("l_suppkey") % 7 == 0, 1899).otherwise(F.col("ANO")),
    })
    # Joined once, doubled after it.
    sent = F.when(F.col("l_partkey") % 10 == 0, 2).otherwise(1)
    return once.withColumn("_sent", F.explode(F.array_repeat(F.lit(1), sent))).drop("_sent", "l_partkey", "l_suppkey")


def aligned_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The view in the canonical columns with lineage, ready to clean."""
    aligned = align(case_view(spark, folder), keep=["enfermedad"])
    return aligned.withColumns({
        "source_name": F.lit("star"), "source_file": F.lit("lineitem.parquet"),
    })


def decoded_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The view with the columns the dashboard queries read.

    Unused ones cost nothing: the optimizer prunes them down to the scans.
    """
    view = case_view(spark, folder)
    return view.withColumns({
        "hospitalizado": epi.decode("PAC_HOS", presets.HOSPITAL_STATUS),
        "condicion_final": epi.decode("CON_FIN", presets.FINAL_CONDITIONS),
        "edad_anos": epi.age_in_years("EDAD", "UNI_MED"),
        "confirmados": epi.confirmed_flag(F.lit(0), "nom_est_f_caso", "TIP_CAS"),
    }).withColumn("grupo_etario", epi.age_group("edad_anos"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Training panel of the view, computed once for the steps that reread it."""
    return materialize(training_panel(case_view(spark, folder)))
