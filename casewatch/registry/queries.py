"""Every operator as a query over the test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewatch import presets
from casewatch.functions import dates, epi, numbers, text
from casewatch.operators import (
    aggregates as agg, alerts, align, clean, dedupe, encode, metrics, panel as pan, priors as pri,
    profile, quality, windows,
)
from casewatch.plans import etl, nodes as forest_table, score, train
from casewatch.registry.cases import (
    aligned_cases, case_view, decoded_cases, ordered_cases, panel, raw_cases, table,
)
from casewatch.session import configure, materialize, scratch_path, wide_job
from casewatch.sources import catalog, files, release, sinks

Query = Callable[[SparkSession, str], DataFrame]
DISEASE, REGION = "BUILDING", "ASIA"
MUNICIPALITY = "Municipio_ocurrencia"
RULE = alerts.AlertRule(keep=1.2, medium=1.5, high=2.0, last_weeks=5, limit=20)
# Forests small enough to fit in a check. The published candidates are run, uncut,
# by ``published_constant``, where trees are cheap.
SMALL_FORESTS = [
    train.Candidate("sqrt_7", "sqrt", 7, 6, 0.80, 0.98), train.Candidate("sqrt_10", "sqrt", 10, 6, 0.85, 1.0),
]


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    known = clean.known_places(decoded_cases(spark, folder), "Departamento_ocurrencia")
    return agg.weekly_aggregate(known, low=5, medium=10)


# --- alerts and dashboard --------------------------------------------------------

def alerts_recent_weeks(spark, folder):
    return alerts.outbreak_alerts(
        case_view(spark, folder), DISEASE, RULE, place=MUNICIPALITY
    )


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    """The view with a finer place: nation and sex, small cells with large ratios."""
    return case_view(spark, folder).withColumn("sector", F.concat_ws(" ", MUNICIPALITY, "SEXO"))


def alerts_latest_week(spark, folder):
    """The published view's preset; its last week is that of the last year."""
    return alerts.outbreak_alerts(
        sectors(spark, folder), "AUTOMOBILE", alerts.LATEST_WEEK, place="sector", by_year=True
    )


def alerts_published_recent(spark, folder):
    """The published service's preset."""
    return alerts.outbreak_alerts(
        sectors(spark, folder), "HOUSEHOLD", alerts.RECENT_WEEKS, place="sector", by_year=True
    )


def alerts_weekly_table(spark, folder):
    return alerts.outbreak_alerts(
        weekly(spark, folder), "AUTOMOBILE", RULE, place="departamento", count="total_casos",
        year="año", by_year=True,
    )


def alerts_by_year(spark, folder):
    return alerts.outbreak_alerts(
        case_view(spark, folder), DISEASE, RULE, place=MUNICIPALITY, by_year=True
    )


def alert_severity_rollup(spark, folder):
    found = alerts_recent_weeks(spark, folder)
    every = alerts.alert_rollup(found).withColumn("scope", F.lit("all"))
    one = alerts.alert_rollup(found, "nation_12").withColumn("scope", F.lit("nation_12"))
    return every.unionByName(one)


def departments_at_risk(spark, folder):
    return alerts.departments_at_risk(alerts_latest_week(spark, folder))


def disease_summary(spark, folder):
    return agg.hospital_share(agg.disease_summary(decoded_cases(spark, folder)))


def disease_summary_truncated(spark, folder):
    return agg.disease_summary(decoded_cases(spark, folder), truncate=True)


def peak_week(spark, folder):
    return agg.peak_week(weekly(spark, folder), DISEASE, count="total_casos")


def peak_week_by_year(spark, folder):
    return agg.peak_week(case_view(spark, folder), DISEASE, by_year=True)


def weekly_series(spark, folder):
    return agg.weekly_series(decoded_cases(spark, folder), DISEASE.lower(), REGION.lower())


def weekly_by_place(spark, folder):
    return agg.weekly_by_place(weekly(spark, folder))


def sum_by_key(spark, folder):
    blanked = weekly(spark, folder).withColumn(
        "departamento", F.nullif(F.col("departamento"), F.lit(REGION))
    )
    return agg.sum_by_key(blanked, "departamento", ["total_casos", "hospitalizados"])


def department_ranking(spark, folder):
    return agg.department_ranking(decoded_cases(spark, folder), DISEASE, n=4)


def department_cases(spark, folder):
    return agg.department_cases(weekly(spark, folder))


def municipality_ranking(spark, folder):
    ranking = agg.municipality_ranking(case_view(spark, folder), DISEASE, REGION.lower())
    return clean.require_rows(ranking, "no municipality in that department")


def municipality_cases(spark, folder):
    return agg.municipality_cases(case_view(spark, folder))


def department_totals(spark, folder):
    return agg.department_totals(decoded_cases(spark, folder), DISEASE)


def age_distribution(spark, folder):
    return agg.age_distribution(decoded_cases(spark, folder), DISEASE, REGION).orderBy("orden")


def age_by_place(spark, folder):
    return agg.age_by_place(decoded_cases(spark, folder))


def sex_distribution(spark, folder):
    return agg.sex_distribution(decoded_cases(spark, folder), DISEASE)


def sex_by_place(spark, folder):
    return agg.sex_by_place(case_view(spark, folder))


def disease_counts(spark, folder):
    return agg.disease_counts(case_view(spark, folder)).orderBy(F.desc("casos"))


def health_count(spark, folder):
    return agg.health_count(case_view(spark, folder))


def picker_lists(spark, folder):
    cases = case_view(spark, folder)
    places = agg.pick_list(cases, "Departamento_ocurrencia", enfermedad=DISEASE)
    cities = agg.pick_list(cases, MUNICIPALITY, Departamento_ocurrencia=REGION)
    return places.withColumn("list", F.lit("department")).unionByName(
        cities.withColumn("list", F.lit("city"))
    ).orderBy("list", "label")


def paged_series(spark, folder):
    """Row-range paging: the limit is the feature."""
    return agg.page(
        agg.weekly_by_place(weekly(spark, folder)),
        ["enfermedad", "departamento", "semana"], size=50, start=100,
    )


def filtered_cases(spark, folder):
    wanted = clean.where_equals(
        case_view(spark, folder), enfermedad=DISEASE.lower(), Departamento_ocurrencia=REGION
    )
    kept = clean.known_sex(clean.known_places(wanted, MUNICIPALITY))
    return kept.select("CONSECUTIVE", "SEMANA", "ANO", MUNICIPALITY, "SEXO")


# --- cleaning -----------------------------------------------------------------------

def clean_cases(spark, folder):
    return clean.clean_cases(aligned_cases(spark, folder))


def text_normalize(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("normal"),
        text.normalize_name("source").alias("source_key"),
    )
    return text.normalize_text_columns(documents, ["normal"])


def title_case(spark, folder):
    names = table(spark, folder, "nation").select(
        "n_nationkey", F.concat("n_name", F.lit(" d.c.-o'x")).alias("name")
    )
    return names.select(
        "n_nationkey", text.title_words("name").alias("words"),
        text.title_blank_separated(F.concat(F.lit("  "), F.col("name"))).alias("blanks"),
        text.normalize_key(F.concat(F.lit(" "), F.lower("name"))).alias("key"),
    )


def disease_names(spark, folder):
    kinds = {0: "dengue ", 1: "CHIKUNGUYA", 2: "malaria vivax", 3: "Málaria"}
    raw = F.col("c_mktsegment")
    for rest, name in kinds.items():
        raw = F.when(F.col("c_custkey") % 5 == rest, name).otherwise(raw)
    return table(spark, folder, "customer").select(
        "c_custkey", text.normalize_disease(raw).alias("disease")
    )


def code_normalize(spark, folder):
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 6
    raw = (
        F.when(kind == 0, F.concat(key, F.lit(".0"))).when(kind == 1, F.concat(F.lit(" "), key))
        .when(kind == 2, F.concat(F.lit("A"), key)).when(kind == 3, "SD").when(kind == 4, "x")
        .otherwise(key)
    )
    return table(spark, folder, "part").select(
        "p_partkey", text.normalize_code(raw, 2).alias("code_2"),
        text.normalize_code(raw, 5).alias("code_5"),
    )


def number_parse(spark, folder):
    kind = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    raw = (
        F.when(kind == 0, F.concat(size, F.lit(".5"))).when(kind == 1, F.concat(size, F.lit("d")))
        .when(kind == 2, "inf").when(kind == 3, F.concat(F.lit(" -"), size, F.lit(" ")))
        .when(kind == 4, "1e2").otherwise(size)
    )
    return table(spark, folder, "part").select(
        "p_partkey", numbers.to_int(raw).alias("whole"), numbers.to_double(raw).alias("number"),
    )


def date_parse_two_pass(spark, folder):
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    shown = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(kind == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 3, F.date_format(day, "yyyy/MM/dd HH:mm:ss"))
        .otherwise("sin fecha")
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.parse_date(shown).alias("parsed")
    )


def week_calendar(spark, folder):
    weeks = case_view(spark, folder).groupBy("ANO", "SEMANA").agg(F.count(F.lit(1)).alias("n"))
    return weeks.select(
        "ANO", "SEMANA", "n", dates.iso_week_month("ANO", "SEMANA").alias("month"),
        dates.iso_week_month("ANO", F.col("SEMANA") + 1).alias("next_month"),
        dates.calendar_week_monday("ANO", "SEMANA").alias("monday"),
    )


def finite_values(spark, folder):
    items = table(spark, folder, "part").select("p_partkey", F.when(
        F.col("p_partkey") % 4 == 0, F.lit(float("nan"))
    ).when(F.col("p_partkey") % 4 == 1, F.lit(float("-inf"))).otherwise(
        F.col("p_retailprice")
    ).alias("price"))
    return numbers.finite_or_null(items)


def dedupe_cases(spark, folder):
    return dedupe.dedupe_cases(
        ordered_cases(spark, folder), order_by=["row_place"], copies="copies"
    ).drop("row_place")


def dedupe_removed(spark, folder):
    return dedupe.count_removed(dedupe_cases(spark, folder), "copies")


def reject_split(spark, folder):
    cases = case_view(spark, folder, "l_partkey", "l_suppkey").withColumns({
        "enfermedad": F.when(F.col("l_partkey") % 11 != 0, F.col("enfermedad")),
        "SEMANA": F.when(F.col("l_partkey") % 13 != 0, F.col("SEMANA")),
        "ANO": F.when(F.col("l_suppkey") % 7 != 0, F.col("ANO")),
    }).drop("l_partkey", "l_suppkey")
    valid, rejected = clean.split_rejected(cases)
    columns = ["enfermedad", "ANO", "SEMANA", "Departamento_ocurrencia", MUNICIPALITY]
    keep = valid.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    drop = rejected.groupBy(*columns, F.array_join("reject_reason", "|").alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return keep.withColumn("reason", F.lit("")).unionByName(drop)


def quality_report(spark, folder):
    cases = case_view(spark, folder)
    # Report and weekly rows both read the deduplicated table.
    flagged = materialize(clean.flag_rejected(dedupe_cases(spark, folder)))
    aggregate = flagged.filter("not is_rejected").select(
        "enfermedad", "ANO", "SEMANA", "Departamento_ocurrencia"
    ).distinct()
    return quality.quality_report(flagged, cases.columns, copies="copies", weekly=aggregate)


def weekly_aggregate(spark, folder):
    return agg.sort_weekly(weekly(spark, folder))


def schema_align(spark, folder):
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("Código caso"),
        F.when(F.col("c_custkey") % 2 == 0, "2023").alias("YEAR"),
        F.lit("2022").alias("ANO"),
        F.col("c_nationkey").cast("string").alias("cod mpio-o"),
        F.col("c_mktsegment").alias("not a case column"),
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.lit(None).cast("string").alias("AÑO"),
        F.col("s_nationkey").cast("string").alias("COD_MUN_O"),
        F.col("s_name").alias("evento nombre"),
    )
    columns = [
        "CONSECUTIVE", "COD_EVE", "Nombre_evento", "ANO", "COD_MUN_O", "confirmados",
        *presets.LINEAGE_COLUMNS,
    ]
    known = [("Dengue", 210, 2024), ("Malaria", 490, 2021)]
    return align.union_filled([
        (align.align_source(raw, *what, "medata", name, fill=False), align.source_defaults(*what))
        for raw, name, what in zip([customer, supplier], ["customer.parquet", "supplier.parquet"], known, strict=True)
    ]).select(*columns)


# --- files and sinks ------------------------------------------------------------------

def file_validation(spark, folder):
    kind = F.col("page_id") % 4
    content = F.when(kind == 0, F.concat(F.lit("a,b,c\n"), F.repeat(F.lit("1,2,3\n"), 40))).when(
        kind == 1, F.lit("a,b\n1,2\n")
    ).when(kind == 2, F.concat(F.lit("PK"), F.col("html"))).otherwise(F.col("html"))
    name = F.concat(F.col("page_id").cast("string"), F.when(kind >= 2, ".xlsx").otherwise(".csv"))
    name = F.when(F.col("page_id") % 8 == 3, F.concat(F.col("page_id").cast("string"), F.lit(".csv"))).otherwise(name)
    raw = F.encode(content, "UTF-8")
    return table(spark, folder, "pages").select(
        "page_id", name.alias("filename"), F.octet_length(raw).cast("long").alias("size_bytes"),
        catalog.is_valid_file(name, raw).alias("is_valid"),
    )


def round_trip_sinks(spark, folder):
    out = scratch_path(spark)
    sinks.load_table(weekly(spark, folder), f"{out}/weekly.parquet")
    return files.read_processed(spark, out, "weekly")


def prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction-shaped rows: one per disease, place and month of the view."""
    return case_view(spark, folder).groupBy(
        F.col("enfermedad").alias("disease"), F.month("FEC_NOT").alias("month"),
        F.col("Departamento_ocurrencia").alias("department"),
        F.col(MUNICIPALITY).alias("city"),
    ).agg(F.count(F.lit(1)).cast("int").alias("estimated_cases"))


def upsert_predictions(spark, folder):
    path = f"{scratch_path(spark)}/predictions"
    rows = prediction_rows(spark, folder)
    sinks.upsert_partitions(rows.filter("month <= 8"), path, presets.PREDICTION_KEY)
    update = rows.filter("month >= 5").withColumn("estimated_cases", F.col("estimated_cases") + 1000)
    return sinks.upsert_partitions(update, path, presets.PREDICTION_KEY)


def load_audit(spark, folder):
    out = scratch_path(spark)
    sinks.write_table(case_view(spark, folder).select("enfermedad", "SEMANA"), f"{out}/clean.parquet")
    sinks.write_table(weekly(spark, folder), f"{out}/weekly.parquet")
    sinks.append_audit(sinks.audit_row(spark, "an earlier load", 1, 2), f"{out}/audit")
    sinks.load_dashboard(spark, out, f"{out}/serving", f"{out}/audit")
    return agg.latest_load(spark.read.parquet(f"{out}/audit")).drop("loaded_at")


def etl_artefacts(spark: SparkSession, folder: str) -> str:
    """Aliased CSV per disease, through the whole job; the folder of the published artefacts."""
    out = scratch_path(spark)
    renamed = raw_cases(spark, folder).withColumnsRenamed({
        "CONSECUTIVE": "Código caso", "FEC_NOT": "Fecha de notificación",
        "Departamento_ocurrencia": "DEPARTAMENTO", MUNICIPALITY: "municipio",
    })
    with wide_job(spark):
        sinks.write_per_disease(renamed, f"{out}/raw")
    # The configured sources; a disease without a file is skipped by the job.
    sources = [
        etl.Source(n, 210, 2024, "star", f"{out}/raw/slug={n.lower()}")
        for n in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "ABSENT")
    ]
    etl.publish(spark, sources, f"{out}/processed", csv_copies=True)
    return release.current(spark, f"{out}/processed")


def full_etl(spark, folder):
    """What the job wrote, read back: the report twice, rejects, rows per disease file."""
    out = etl_artefacts(spark, folder)

    def counted(df: DataFrame, artefact: str, metric: Column) -> DataFrame:
        return df.groupBy(metric.alias("metric")).agg(F.count(F.lit(1)).alias("value")).withColumn("artefact", F.lit(artefact))

    report = spark.read.schema("metric string, value long").json(f"{out}/quality.json")
    as_csv = spark.read.csv(f"{out}/quality.csv", header=True).select("metric", F.col("value").cast("long"))
    return agg_union([
        report.withColumn("artefact", F.lit("quality.json")), as_csv.withColumn("artefact", F.lit("quality.csv")),
        counted(spark.read.csv(f"{out}/rejected.csv", header=True), "rejected.csv", F.col("reject_reason")),
        counted(spark.read.csv(f"{out}/clean_by_disease", header=True), "clean_by_disease", F.col("slug")),
        counted(files.read_processed(spark, out, "clean"), "clean.parquet", F.col("enfermedad")),
    ])


def agg_union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def etl_weekly(spark, folder):
    """The weekly table the job wrote, with the published risk bounds."""
    return spark.read.parquet(f"{etl_artefacts(spark, folder)}/weekly.parquet")


def csv_scan(spark, folder):
    """Files of different headers, sizes and encodings in one folder, each body read once."""
    out = scratch_path(spark)
    kind = F.col("o_orderkey") % 7
    order = table(spark, folder, "orders").withColumn(
        "place", F.concat(F.lit("Bogotá "), F.translate("o_orderpriority", "EIOU", "ÉÍÓÜ")))
    parts = [
        (~kind.isin(1, 2, 3), ["o_orderkey", "o_custkey", "o_orderstatus", "place"], "UTF-8"),
        (kind == 1, ["o_orderstatus", "o_orderkey", "o_custkey", "place"], "ISO-8859-1"),
        (kind == 2, ["o_orderpriority", "o_orderkey"], "UTF-8"),
        (kind == 3, ["o_orderkey", "o_custkey", "o_orderstatus", "place"], "ISO-8859-1"),
    ]
    for wanted, columns, encoding in parts:
        order.filter(wanted).select(*columns).write.mode("append").csv(out, header=True, encoding=encoding)
    return files.read_csv(spark, out).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "place")


def raw_file_check(spark, folder):
    """Signatures of files that hold pages, a folder per file name; only their heads are read."""
    out = scratch_path(spark)
    kind = F.col("page_id") % 48
    body = F.when(kind % 4 == 0, F.concat(F.lit("PK"), F.col("html"))).when(
        kind % 4 == 1, F.concat(F.repeat(F.lit("a,b,c\n"), 99), F.col("html"))).otherwise(F.col("html"))
    name = F.concat(kind.cast("string"), F.when(kind % 3 == 0, ".xlsx").when(kind % 3 == 1, ".csv").otherwise(".json"))
    written = table(spark, folder, "pages").select("page_id", name.alias("name"), body.alias("body"))
    ordered = written.repartition("name").sortWithinPartitions("name", "page_id").drop("page_id")
    ordered.write.partitionBy("name").text(out)
    return catalog.raw_files(spark, out, F.regexp_extract("path", "/name=([^/]+)/", 1)).drop("path")


def ingest_manifest(spark, folder):
    """Status of every configured source against files of which pages stand in for content."""
    catalogue = catalog.source_catalog(spark)
    # The last source has no file; its pages stand in for one that nobody asked for.
    names = F.array(*[F.lit(row[5]) for row in presets.SOURCES[:-1]], F.lit("unlisted.csv"))
    kind = F.col("page_id") % F.lit(len(presets.SOURCES))
    content = F.when(kind == 0, F.repeat(F.lit("a,b\n1,2\n"), 200)).when(kind == 1, F.concat(F.lit("PK"), F.col("html"))).otherwise(F.col("html"))
    body = F.encode(content, "UTF-8")
    pages = table(spark, folder, "pages").select(
        F.element_at(names, (kind + 1).cast("int")).alias("filename"), F.concat(F.lit("raw/"), F.col("page_id").cast("string")).alias("path"),
        F.octet_length(body).cast("long").alias("size_bytes"),
        catalog.is_valid_file(F.element_at(names, (kind + 1).cast("int")), body).alias("is_valid"))
    found = catalog.ingest_manifest(catalogue, pages)
    return found.groupBy("disease", "filename", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size_bytes"))


# --- panel and priors ---------------------------------------------------------------------

def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    scale = float(10**digits)
    return df.withColumns({c: F.rint(F.col(c) * scale) / scale for c in columns})


def monthly_panel(spark, folder):
    return pan.monthly_panel(case_view(spark, folder))


def climate_profile_of_nation() -> Column:
    """Nations stand in for departments; every third has no profile."""
    names = [row[0] for row in presets.CLIMATE_PROFILES]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("n_nationkey") + 9)


def climate_features(spark, folder):
    nation = table(spark, folder, "nation").select(
        F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))
        .otherwise(climate_profile_of_nation()).alias("department"), "n_nationkey",
    )
    months = monthly_panel(spark, folder).groupBy("month").agg(
        F.sum("total_cases").alias("total_cases")
    )
    # Twelve rows by construction; every nation gets every month.
    each = nation.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(
        F.broadcast(months), "month"
    )
    both = pan.climate_features(each).withColumn("compat", F.lit(False)).unionByName(
        pan.climate_features(each, reference_compat=True).withColumn("compat", F.lit(True))
    )
    return rounded(both, "month_sin", "month_cos")


def temporal_features(spark, folder):
    return rounded(
        windows.temporal_features(monthly_panel(spark, folder)),
        "cases_previous_3_month_mean", "cases_previous_6_month_mean", "cases_trend_3m",
    )


def weekly_lags(spark, folder):
    events = table(spark, folder, "events").groupBy(
        "event_type", F.to_date(F.date_trunc("week", "ts")).alias("monday")
    ).agg(F.count(F.lit(1)).alias("n"))
    return rounded(
        windows.weekly_lags(events, "n", ["event_type"], ["monday"], lags=(1, 2, 4)), "n_ma4"
    )


def seen(df: DataFrame) -> DataFrame:
    """Part of the panel priors are fitted on: one disease and one region unseen."""
    return df.filter((F.col("disease") != "Building") & (F.col("department") != "ASIA"))


def prior_features(spark, folder):
    rows = materialize(monthly_panel(spark, folder))
    return pri.apply_priors(rows, pri.Priors.fit(seen(rows)).stored())


def scored_lags(spark: SparkSession, folder: str, compat: bool) -> DataFrame:
    cases = case_view(spark, folder)
    fitted = pri.Priors.fit(seen(pan.monthly_panel(cases))).stored()
    features = pri.scoring_features(pan.scoring_scaffold(cases), fitted, compat)
    keep = [
        "disease", "department", "municipality", "month", "cases_previous_month",
        "cases_previous_2_month_mean", "cases_previous_3_month_sum",
        "cases_previous_6_month_mean", "cases_trend_1m",
    ]
    return rounded(features.select(*keep), *keep[4:])


def inference_lags(spark, folder):
    return scored_lags(spark, folder, compat=False)


def inference_lags_compat(spark, folder):
    return scored_lags(spark, folder, compat=True)


def scoring_inputs(spark, folder):
    ready = score.scoring_inputs(pan.scoring_scaffold(case_view(spark, folder)))
    return rounded(ready, "month_sin", "month_cos")


def outbreak_scalars(spark, folder):
    rows = monthly_panel(spark, folder).groupBy("total_cases").agg(
        F.count(F.lit(1)).alias("n")
    )
    y = F.col("total_cases")
    return rounded(
        rows.select(
            "total_cases", "n", epi.outbreak_level("total_cases").alias("level"),
            epi.transform_target("total_cases", "log1p").alias("log_y"),
            epi.transform_target("total_cases", "sqrt").alias("sqrt_y"),
            epi.inverse_target(epi.transform_target("total_cases", "log1p"), "log1p").alias("back_log"),
            epi.inverse_target(F.sqrt(y), "sqrt").alias("back_sqrt"),
            epi.sample_weight("total_cases").alias("weight"),
        ),
        "log_y", "sqrt_y", "back_log", "back_sqrt", "weight",
    )


def prediction_lookup(spark, folder):
    return clean.find_prediction(
        prediction_rows(spark, folder), DISEASE.lower(), 3, " asia", "Nation_2 "
    )


# --- modelling --------------------------------------------------------------------------------

def regression_metrics(spark, folder):
    rows = windows.temporal_features(monthly_panel(spark, folder))
    return metrics.evaluate(rows, "total_cases", "cases_previous_month", "disease")


def blend_select(spark, folder):
    rows = materialize(windows.temporal_features(monthly_panel(spark, folder)))
    features = pri.apply_priors(rows, pri.Priors.fit(seen(rows)).stored())
    return rounded(
        metrics.blend_scores(features, "total_cases", "cases_previous_month"), "score"
    )


def stratified_split(spark, folder):
    """Which rows are drawn, by key."""
    split = metrics.stratified_split(materialize(monthly_panel(spark, folder)), train.KEY)
    return split.select(*train.KEY, "total_cases", "bin", "is_test")


def forest_train_score(spark, folder):
    """Few trees; trains, stores, reloads, scores and publishes."""
    cases = case_view(spark, folder)
    bundle = train.train_bundle(panel(spark, folder), SMALL_FORESTS, per_disease=False)
    out = scratch_path(spark)
    train.save_bundle(spark, bundle, f"{out}/model")
    return score.publish(
        cases, train.load_bundle(spark, f"{out}/model"), f"{out}/predictions", f"{out}/audit"
    )


def forest_nodes(spark, folder):
    """Forests on real counts as node tables: rows scored by joins, rows that differ, unbalanced nodes, trees."""
    rows = panel(spark, folder)
    known = train.with_priors(rows, pri.Priors.fit(rows).stored())
    features = train.fit_features(known)
    ready = materialize(features.apply(known))
    checks = []
    for candidate in SMALL_FORESTS:
        pipeline = train.fit_forest(ready, candidate, features)
        scored = materialize(pipeline.transform(ready).select(*train.KEY, "_features", train.RAW))
        nodes = materialize(forest_table.node_table(spark, pipeline.stages[-1]))
        both = materialize(forest_table.score_by_nodes(scored, nodes, train.KEY, candidate.depth).join(scored, train.KEY))
        gap = F.abs(F.col("_by_nodes") - F.col(train.RAW)) > 1e-9
        counts = [
            ("rows scored", both.agg(F.count(F.lit(1)).alias("n"))), ("rows that differ", both.agg(F.count_if(gap).alias("n"))),
            ("unbalanced nodes", forest_table.unbalanced(nodes).agg(F.count(F.lit(1)).alias("n"))),
            ("trees", nodes.agg(F.count_distinct("tree").alias("n"))),
            # A tree of depth 6 on varied counts is no stump.
            ("trees of one node", nodes.groupBy("tree").count().agg(F.count_if(F.col("count") < 2).alias("n"))),
        ]
        checks += [n.select(F.lit(candidate.name).alias("forest"), F.lit(what).alias("what"), "n") for what, n in counts]
    return agg_union(checks)


CONSTANT = 9.0


def published_constant(spark, folder):
    """All candidates as published, on a target that never varies: train, store, load, publish.

    Every forest, blend, lag and metric then has one right value, whatever the trees'
    random draws; r2 is left out, as a constant has no variance to explain.
    """
    cases = case_view(spark, folder)
    flat = pan.monthly_panel(cases).withColumn("total_cases", F.lit(CONSTANT))
    rows = materialize(pan.climate_features(windows.temporal_features(flat)))
    out = scratch_path(spark)
    train.save_bundle(spark, train.train_bundle(rows, per_disease=False), f"{out}/model")
    return score.publish(
        cases, train.load_bundle(spark, f"{out}/model"), f"{out}/predictions", f"{out}/audit"
    ).drop("validation_r2")


def model_routing(spark, folder):
    """Which model scores each disease, by its months with more than one case."""
    return train.model_names(monthly_panel(spark, folder).filter("total_cases > 1"), 1950)


def model_selection(spark, folder):
    """The best of all candidates and blends; lags stand in for forests."""
    rows = materialize(windows.temporal_features(monthly_panel(spark, folder)))
    features = materialize(pri.apply_priors(rows, pri.Priors.fit(rows).stored()))
    scored = []
    for name in ("cases_previous_month", "cases_previous_3_month_mean", "cases_previous_month"):
        found = metrics.blend_scores(features, "total_cases", name).orderBy("blend_order")
        scored += [{"candidate": name, **r.asDict()} for r in found.collect()]  # four blends each
    best = train.select_best(scored)
    chosen = spark.createDataFrame([(best["candidate"], best["blend"])], "candidate string, blend string")
    measured = metrics.blend_scores(features, "total_cases", best["candidate"])
    return rounded(measured.join(chosen, "blend").select("candidate", "blend", "mae", "wape_pct", "score"), "score")


def category_index(spark, folder):
    """Fitted feature table: numbers and one-hot places of categories, modes, exact medians."""
    rows = materialize(monthly_panel(spark, folder))
    names, numbers = ["disease", "department", "municipality"], ["year", "month", "total_cases"]
    fitted = encode.FeatureTable.fit(rows, names, numbers)
    seen_values = fitted.apply(rows.select(*names, *numbers))
    for stage in train.feature_stages(fitted)[:1]:
        seen_values = stage.transform(seen_values)
    hot = {c: vector_to_array(F.col(f"_hot_{c}")) for c in names}
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(c).alias("value"), F.col(f"_idx_{c}").cast("int").alias("number"),
            (F.array_position(hot[c], F.lit(1.0)) - 1).cast("int").alias("hot"), F.size(hot[c]).alias("width"),
        ) for c in names
    ])
    encoded = seen_values.select(F.inline(pairs)).distinct()
    table = fitted.table.select("column", "value", "mode", "median")
    return table.join(encoded, ["column", "value"], "left")


def prior_features_all(spark, folder):
    """Priors fitted on every row they are applied to."""
    rows = materialize(monthly_panel(spark, folder))
    return pri.apply_priors(rows, pri.Priors.fit(rows).stored())


def training_panel(spark, folder):
    """The whole panel with all features that need no priors, through its sink."""
    out = scratch_path(spark)
    sinks.write_table(pan.training_panel(case_view(spark, folder)), out)
    return rounded(
        spark.read.parquet(out), "month_sin", "month_cos", "cases_previous_3_month_mean",
        "cases_previous_6_month_mean", "cases_trend_3m")


def forest_per_disease(spark, folder):
    """Metrics of the global and the per-disease models, one small forest each."""
    bundle = train.train_bundle(panel(spark, folder), SMALL_FORESTS[:1])
    return train.metrics_table(spark, bundle)


# --- exploration --------------------------------------------------------------------------------

def describe_table(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id", "value", "event_type", "props", F.to_date("ts").cast("string").alias("day")
    )
    return rounded(profile.describe(events), "mean", "std", "min", "q25", "q50", "q75", "max", digits=4)


def null_profile(spark, folder):
    return quality.null_profile(case_view(spark, folder))


def correlation_matrix(spark, folder):
    lagged = windows.weekly_lags(
        weekly(spark, folder), "total_casos", ["enfermedad", "departamento"], ["año", "SEMANA"]
    )
    columns = [
        "total_casos", "edad_promedio", "pct_femenino", "total_casos_lag_2w",
        "total_casos_lag_4w", "total_casos_ma4", "not_there",
    ]
    return rounded(profile.correlation_matrix(lagged, columns), "corr")


def seasonality(spark, folder):
    return rounded(agg.seasonality(weekly(spark, folder)), "mean_total_casos")


def national_series(spark, folder):
    return agg.national_series(weekly(spark, folder))


def risk_distribution(spark, folder):
    return agg.label_counts(weekly(spark, folder), "risk_label")


def total_by_department(spark, folder):
    return agg.total_by(weekly(spark, folder), "departamento", "total_casos", n=15)


def top_departments_semi(spark, folder):
    rows = weekly(spark, folder).withColumnRenamed("departamento", "department")
    return agg.only_top(rows, "department", "total_casos", n=3).select(
        "enfermedad", "department", "año", "SEMANA", "total_casos"
    )


def box_stats(spark, folder):
    return profile.box_stats(
        agg.only_top(weekly(spark, folder), "departamento", "total_casos"),
        "departamento", "total_casos",
    )


def source_counts(spark, folder):
    """Configured sources next to the rows of the disease each one covers."""
    diseases = case_view(spark, folder).groupBy(
        F.element_at(
            F.array(*[F.lit(x) for x in ("Dengue", "Malaria", "Chikungunya")]),
            F.pmod(F.length("enfermedad"), F.lit(3)) + 1,
        ).alias("disease")
    ).agg(F.count(F.lit(1)).alias("n"))
    return catalog.source_catalog(spark, 2024).join(diseases, "disease", "left")


QUERIES: list[Query] = [
    alerts_recent_weeks, alerts_latest_week, alerts_published_recent, alerts_weekly_table, alerts_by_year,
    alert_severity_rollup, departments_at_risk, disease_summary,
    disease_summary_truncated, peak_week, peak_week_by_year, weekly_series,
    weekly_by_place, sum_by_key, department_ranking, department_cases,
    municipality_ranking, municipality_cases, department_totals, age_distribution,
    age_by_place, sex_distribution, sex_by_place, disease_counts, health_count,
    picker_lists, paged_series, filtered_cases, clean_cases, text_normalize,
    title_case, disease_names, code_normalize, number_parse, date_parse_two_pass,
    week_calendar, finite_values, dedupe_cases, dedupe_removed, reject_split,
    quality_report, weekly_aggregate, schema_align, file_validation, raw_file_check,
    round_trip_sinks, upsert_predictions, load_audit, full_etl, etl_weekly, csv_scan,
    ingest_manifest, monthly_panel,
    climate_features, temporal_features, weekly_lags, prior_features,
    inference_lags, inference_lags_compat, scoring_inputs, outbreak_scalars,
    prediction_lookup, regression_metrics, blend_select, stratified_split,
    forest_train_score, forest_per_disease, forest_nodes, published_constant, model_routing, model_selection,
    category_index, prior_features_all, training_panel, describe_table, null_profile,
    correlation_matrix, seasonality, national_series, risk_distribution,
    total_by_department, top_departments_semi, box_stats, source_counts,
]


def configured(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(configure(spark), folder)

    return run


def all_queries() -> dict[str, Query]:
    return {query.__name__: configured(query) for query in QUERIES}
