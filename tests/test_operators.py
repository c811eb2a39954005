"""Operators on tiny frames with hand-computed answers, and their properties."""

import pytest
from pyspark.sql import functions as F

from casewatch import presets
from casewatch.operators import (
    aggregates, alerts, align, clean, dedupe, metrics, panel, priors, profile, quality, windows,
)
from casewatch.registry.cases import case_view, decoded_cases


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_align_first_match_and_collapse(spark):
    df = spark.createDataFrame(
        [("2023", "2020", "a"), (None, "2021", "b")], "YEAR string, ANO string, `Código caso` string"
    )
    got = align.align(df).select("CONSECUTIVE", "ANO", "SEXO")
    assert rows(got) == [("a", "2023", None), ("b", "2021", None)]
    assert align.align(df).columns == presets.CANONICAL_COLUMNS


def test_align_repeated_headers(spark):
    df = spark.createDataFrame([("1", "2")], "x string, y string").toDF("EDAD ", "edad")
    # Equal after normalisation: the last one stands for both.
    assert align.final_names(df.columns) == ["EDAD ", "EDAD"]


def test_fill_only_when_whole_source_is_empty(spark):
    df = spark.createDataFrame([("1", None), (None, None)], "a string, b string")
    got = align.fill_empty_columns(df, {"a": "9", "b": "8"})
    assert sorted(rows(got), key=str) == [("1", "8"), (None, "8")]


def test_require_columns(spark):
    with pytest.raises(align.MissingColumnsError):
        align.require_columns(spark.range(1), ["nope"])
    with pytest.raises(align.MissingColumnsError):
        panel.monthly_panel(spark.range(1))


def test_union_without_sources():
    with pytest.raises(FileNotFoundError):
        align.union_sources([])


SCHEMA = "enfermedad string, CONSECUTIVE string, COD_EVE int, v string, ordinal int"


def test_dedupe(spark):
    df = spark.createDataFrame([
        ("D", "1", 210, "second", 2), ("D", "1", 210, "first", 1), ("D", "1", None, "x", 3),
        ("D", "1", None, "y", 4), ("D", None, 210, "same", 5), ("D", None, 210, "same", 6),
        ("D", None, 210, "other", 7), ("D", "SIN_DATO", 210, "s", 8),
    ], SCHEMA)
    got = dedupe.dedupe_cases(df, order_by=["ordinal"], copies="n")
    assert rows(got.select("ordinal", "v", "n")) == [
        (1, "first", 2), (3, "x", 2), (5, "same", 2), (7, "other", 1), (8, "s", 1)
    ]
    assert rows(dedupe.count_removed(got, "n")) == [(8, 5, 3)]


def test_dedupe_hot_key_and_idempotence(spark):
    # A third of all rows shares one id.
    df = spark.range(3000).select(
        F.lit("D").alias("enfermedad"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("CONSECUTIVE"),
        F.lit(1).alias("COD_EVE"), F.lit("v").alias("v"), F.col("id").cast("int").alias("ordinal"),
    )
    once = dedupe.dedupe_cases(df, order_by=["ordinal"])
    assert once.count() == 2001
    assert once.filter("CONSECUTIVE = 'hot'").head()["ordinal"] == 0
    assert rows(dedupe.dedupe_cases(once, order_by=["ordinal"])) == rows(once)
    shuffled = dedupe.dedupe_cases(df.repartition(7), order_by=["ordinal"])
    assert rows(shuffled) == rows(once)


def test_dedupe_plan_has_one_shuffle(spark, folder):
    plan = dedupe.dedupe_cases(
        spark.read.parquet(f"{folder}/orders.parquet").withColumnsRenamed({
            "o_orderstatus": "enfermedad", "o_orderpriority": "CONSECUTIVE",
            "o_custkey": "COD_EVE",
        })
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_shares_and_alerts_scan_cases_once(spark, folder):
    cases = decoded_cases(spark, folder)
    for df in (
        aggregates.department_ranking(cases, "BUILDING"),
        alerts.outbreak_alerts(cases, "BUILDING"),
    ):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert "ReusedExchange" in plan and final


def test_weekly_counts_stay_hash_aggregates(spark, folder):
    cases = decoded_cases(spark, folder).withColumn(
        "o", F.monotonically_increasing_id().cast("decimal(38,0)")
    )
    plan = aggregates.weekly_aggregate(cases, order_by="o")._jdf.queryExecution().executedPlan()
    # Only the merge of the few codes per group sorts.
    assert plan.toString().count("SortAggregate") == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("d", 1, 5), ("d", None, 6)], "k string, m int, v int")
    new = spark.createDataFrame([("d", None, 7), ("e", 1, 8)], "k string, m int, v int")
    once = dedupe.upsert(old, new, ["k", "m"])
    assert sorted(rows(once), key=str) == [("d", 1, 5), ("d", None, 7), ("e", 1, 8)]
    assert sorted(rows(dedupe.upsert(once, new, ["k", "m"])), key=str) == sorted(rows(once), key=str)
    twice = new.withColumn("o", F.lit(1)).union(spark.createDataFrame([("e", 1, 9, 2)], "k string, m int, v int, o int"))
    last = dedupe.upsert(old, twice, ["k", "m"], order_by=["o"])
    assert last.filter("k = 'e'").head()["v"] == 9


def test_rejects(spark):
    df = spark.createDataFrame([
        (2024, 1, "D", "X"), (None, 1, "D", "X"), (2024, None, None, "SIN_DATO"), (2024, 1, "D", None)
    ], "ANO int, SEMANA int, enfermedad string, Departamento_ocurrencia string")
    valid, rejected = clean.split_rejected(df)
    assert valid.count() == 1 and rejected.count() == 3
    reasons = sorted(tuple(r["reject_reason"]) for r in rejected.collect())
    assert reasons == [("department",), ("week", "disease", "department"), ("year",)]


def test_quality_report(spark):
    df = spark.createDataFrame(
        [("A", None, False, 2), ("A", 1, False, 1), ("B", None, True, 1)],
        "enfermedad string, x int, is_rejected boolean, c long",
    )
    report = dict(rows(quality.quality_report(df, ["x"], copies="c", weekly=spark.range(4))))
    assert report == {
        "total_clean_rows": 2, "total_rejected_rows": 1, "nulls_x": 1, "rows_disease_A": 2,
        "duplicates_removed": 1, "total_aggregated_rows": 4,
    }
    empty = dict(rows(quality.quality_report(df.filter("false"), ["x"])))
    assert empty == {"total_clean_rows": 0, "total_rejected_rows": 0, "nulls_x": 0}


def weekly(spark, counts):
    return spark.createDataFrame(
        [("DENGUE", p, w, n) for p, w, n in counts],
        "enfermedad string, departamento string, SEMANA int, total_casos long",
    )


@pytest.mark.parametrize("latest, level", [(20, "ALTO"), (15, "MEDIO"), (12, "BAJO"), (11, None)])
def test_alert_latest_week(spark, latest, level):
    # The other nine weeks bring the mean to exactly ten.
    rest = 100 - latest
    counts = [("P", w, rest // 9 + (1 if w <= rest % 9 else 0)) for w in range(1, 10)]
    found = alerts.outbreak_alerts(
        weekly(spark, [*counts, ("P", 10, latest)]), "dengue", place="departamento",
        count="total_casos",
    ).collect()
    assert [r["nivel_alerta"] for r in found] == ([level] if level else [])


def test_alert_rollup(spark):
    found = spark.createDataFrame(
        [("A", "MEDIO"), ("B", "ALTO")], "departamento string, nivel_alerta string"
    )
    assert rows(alerts.alert_rollup(found)) == [("ALTO", 2)]
    assert rows(alerts.alert_rollup(found, "a")) == [("MEDIO", 1)]
    assert rows(alerts.alert_rollup(found, "z")) == [("NINGUNO", 0)]


def test_weekly_first_code_and_null_groups(spark):
    df = spark.createDataFrame(
        [("D", 2024, 1, None, None, 0, 3.0, "F", 1), ("D", 2024, 1, None, "05", 1, None, "M", 2),
         ("D", 2024, 1, None, "04", 1, 4.0, "F", 3)],
        "enfermedad string, ANO int, SEMANA int, Departamento_ocurrencia string, COD_DPTO_O string,"
        " confirmados int, edad_anos double, SEXO string, o int",
    ).withColumns({"hospitalizado": F.lit("Hospitalizado"), "condicion_final": F.lit("Vivo")})
    row = aggregates.weekly_aggregate(df, order_by="o").head()
    assert row["cod_dpto"] == "05" and row["total_casos"] == 3 and row["confirmados"] == 2
    assert row["edad_promedio"] == 3.5 and row["pct_femenino"] == 66.67
    assert row["hospitalizados"] == 3 and row["month"] == 1 and row["risk_label"] == "bajo"


def test_shares_sum_to_hundred(spark):
    df = spark.range(7).select(F.col("id").alias("k"), (F.col("id") + 1).alias("n"))
    shares = aggregates.with_share(df, "n", "share", 2)
    assert shares.agg(F.sum("share")).head()[0] == pytest.approx(100, abs=0.05)


def test_empty_result_is_an_error(spark):
    with pytest.raises(clean.NotFoundError):
        clean.require_rows(spark.range(0), "none")


def test_trailing_features(spark):
    df = spark.createDataFrame(
        [("D", "X", "M", 2024, m, float(m * 3)) for m in range(1, 5)],
        "disease string, department string, municipality string, year int, month int, total_cases double",
    )
    got = windows.temporal_features(df).orderBy("month").collect()
    assert [r["cases_previous_3_month_mean"] for r in got] == [0, 3, 4.5, 6]
    assert [r["cases_previous_month"] for r in got] == [0, 3, 6, 9]
    assert [r["cases_trend_1m"] for r in got] == [0, 3, 3, 3]


def test_panel_properties(spark, folder):
    cases = case_view(spark, folder)
    rows_ = panel.monthly_panel(cases)
    total, n = rows_.agg(F.sum("total_cases"), F.count("*")).head()
    kept = clean.known_places(cases, "Departamento_ocurrencia", "Municipio_ocurrencia").count()
    assert n % 12 == 0 and total == kept


def test_panel_names_and_month_fallback(spark):
    df = spark.createDataFrame(
        [("dengue", 2024, 10, "Nariño ", "Pasto"), ("DENGUE", 2024, 10, "NARINO", " pasto"),
         ("DENGUE", 2024, 54, "NARINO", "PASTO"), ("DENGUE", 2024, 1, " ", "PASTO")],
        "enfermedad string, ANO int, SEMANA int, Departamento_ocurrencia string, Municipio_ocurrencia string",
    )
    got = panel.monthly_panel(df).filter("total_cases > 0")
    assert rows(got) == [("Dengue", 2024, "NARINO", "PASTO", 3, 2.0)]


def test_climate_accent_and_compat(spark):
    df = spark.createDataFrame([("NARIÑO",), ("Nowhere",)], "department string")
    assert rows(panel.with_climate_profile(df).select("department", "avg_temp_c")) == [
        ("NARIÑO", 18.0), ("Nowhere", 24.0)
    ]
    compat = panel.with_climate_profile(df, reference_compat=True)
    assert rows(compat.select("department", "avg_temp_c")) == [("NARIÑO", 24.0), ("Nowhere", 24.0)]


KEYS = "disease string, department string, municipality string, month int, total_cases double"


def test_prior_fallbacks(spark):
    fitted = priors.Priors.fit(spark.createDataFrame(
        [("D", "X", "M", 1, 2.0), ("D", "X", "M", 2, 4.0), ("D", "Y", "N", 1, 12.0)], KEYS
    ))
    asked = spark.createDataFrame(
        [("D", "X", "new", 1, 0.0), ("D", "new", "new", 1, 0.0), ("E", "X", "M", 3, 0.0)], KEYS
    )
    got = {(r["disease"], r["department"]): r for r in priors.apply_priors(asked, fitted).collect()}
    unseen_city, unseen_dept, unseen_disease = got["D", "X"], got["D", "new"], got["E", "X"]
    assert unseen_city["municipality_global_mean_cases"] == 3.0
    assert unseen_city["municipality_disease_month_mean_cases"] == 3.0
    assert unseen_dept["department_global_mean_cases"] == 6.0
    assert unseen_dept["disease_month_mean_cases"] == 7.0
    assert unseen_disease["department_disease_mean_cases"] == 3.0
    assert unseen_disease["national_month_mean_cases"] == 6.0


def test_inference_lag_features(spark):
    fitted = priors.Priors.fit(spark.createDataFrame(
        [("D", "X", "M", m, float(m)) for m in range(1, 13)], KEYS
    ))
    asked = spark.createDataFrame([("D", "X", "M", 1), ("D", "X", "M", 2)], KEYS.rsplit(",", 1)[0])
    compat = priors.scoring_features(asked, fitted, True).orderBy("month").collect()
    assert [r["cases_previous_6_month_sum"] for r in compat] == [72.0, 61.0]
    wrapped = priors.scoring_features(asked, fitted).orderBy("month").collect()
    assert wrapped[0]["cases_previous_6_month_sum"] == 12 + 11 + 10 + 9 + 8 + 7


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 5.0)], "y double, p double")
    row = metrics.evaluate(df, "y", "p").head().asDict()
    assert row == {
        "mae": 2.5, "rmse": 3.5355, "r2": 0.5, "mape_non_zero_pct": 50.0, "wape_pct": 50.0,
        "smape_pct": 33.3333,
    }


def test_blend(spark):
    df = spark.createDataFrame([(10.0, 2.0)], "m double, prior double")
    value = metrics.blend("m", {"model": 0.5, "prior": 0.25, "gone": 0.25}, df.columns)
    assert df.select(value.alias("v")).head()["v"] == 5.5
    assert df.select(metrics.blend(F.lit(-3.0), {}).alias("v")).head()["v"] == 0.0


def test_split_is_exact_and_deterministic(spark):
    df = spark.range(1000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") < 600, 0.0).otherwise(F.col("id") % 50).cast("double").alias("total_cases"),
    )
    split = metrics.stratified_split(df, ["k"])
    per_bin = split.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    for row in per_bin.collect():
        assert row["t"] == round(row["n"] * 0.2)
    again = metrics.stratified_split(df.repartition(5), ["k"])
    assert rows(split.filter("is_test").select("k")) == rows(again.filter("is_test").select("k"))


def test_exact_quantiles_against_builtin(spark):
    df = spark.range(5000).select(
        F.rand(3).alias("a"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.randn(4)).alias("b")
    ).cache()
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["probability"]): r["value"]
           for r in profile.exact_quantiles(df, ["a", "b"], points, cells=16).collect()}
    for c in ("a", "b"):
        want = df.agg(F.percentile(c, F.array(*[F.lit(p) for p in points]))).head()[0]
        assert [got[c, p] for p in points] == pytest.approx(want)


@pytest.mark.parametrize("cells", [2**10, 2**16])
def test_exact_quantiles_of_odd_values(spark, cells):
    values = [-0.0, 0.0, -1.5, 1e-300, -1e300, 5e-324, 3.0, 3.0, 3.0, float("inf"), -float("inf"), 7.0]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, 2.0)], "a double, b double")
    got = {(r["column"], r["probability"]): r["value"] for r in profile.exact_quantiles(df, ["a", "b"], [0.2, 0.5, 0.6], cells).collect()}
    for c in ("a", "b"):
        assert [got[c, p] for p in (0.2, 0.5, 0.6)] == df.agg(F.percentile(c, F.array(*[F.lit(p) for p in (0.2, 0.5, 0.6)]))).head()[0]


def test_no_task_ranks_more_than_its_cells(spark, monkeypatch):
    """A million distinct values: no window holds more rows than there are cells."""
    largest, plain = [], profile.materialize

    def watched(df):
        made = plain(df)
        if "earlier" in df._jdf.queryExecution().optimizedPlan().toString():
            largest.append(1)
        return made

    monkeypatch.setattr(profile, "materialize", watched)
    df = spark.range(1_000_000).select(F.sqrt("id").alias("a"))
    got = {r["probability"]: r["value"] for r in profile.exact_quantiles(df, ["a"], [0.25, 0.5], cells=2**8).collect()}
    assert got == {p: pytest.approx(df.agg(F.percentile("a", p)).head()[0], rel=1e-12) for p in (0.25, 0.5)}
    assert len(largest) == 8  # 64 digits, 8 a round
    coded = df.select(profile.ordered_code(F.col("a")).alias("code"))
    for left in range(56, -1, -8):
        rows_of = coded.select(F.shiftright("code", min(left + 8, 63)).alias("cell"), F.shiftright("code", left).alias("next")).distinct()
        assert rows_of.groupBy("cell").count().agg(F.max("count")).head()[0] <= 2**8


def test_cells_are_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        profile.exact_quantiles(spark.range(3), ["id"], [0.5], cells=100)


def test_describe_mixed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "n int, s string")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    assert got["n"]["count"] == 2 and got["n"]["q50"] == 1.5
    assert (got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (2, "a", 2)


def test_box_stats(spark):
    df = spark.createDataFrame([("g", v) for v in [1, 2, 3, 4, 100]], "g string, v long")
    assert rows(profile.box_stats(df, "g", "v")) == [("g", 5, 2.0, 3.0, 4.0, 1, 4, 1)]


def shuffled_fields(df):
    """Per shuffle of the plan: the fields its rows carry."""
    found, pending = [], [df._jdf.queryExecution().executedPlan()]
    while pending:
        node = pending.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_ordered_dedupe_shuffles_whole_rows_once(spark):
    """No place or hash travels beside a whole row, and a row without an id travels once."""
    df = spark.range(100).selectExpr(
        "if(id % 7 = 0, null, id % 9) CONSECUTIVE", "'D' enfermedad", "1 COD_EVE", "cast(id as decimal(38,0)) place", "cast(id as string) v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        deduped = dedupe.dedupe_cases(df, order_by=["place"], copies="n")
        shuffles = shuffled_fields(deduped)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(shuffles) == 4 and ["_place", "_row", "_copies"] in shuffles
    whole = [set(s) for s in shuffles if "v" in s]
    assert len(whole) == 2 and {"CONSECUTIVE", "place", "v"} in whole  # constants are folded
    assert not any("_content" in s for s in shuffles)


def test_ordered_dedupe_without_id_keeps_the_order_column(spark):
    rows_in = [(None, "D", 1, 7, "a"), (None, "D", 1, 5, "a"), ("SIN_DATO", "D", None, 2, "a"), (None, "D", 1, None, "b"),
               (None, "D", 1, 3, "b"), ("9", None, 1, 4, None), ("9", None, 1, 1, "c")]
    for kind in ("int", "bigint", "decimal(18,0)", "decimal(38,0)"):
        df = spark.createDataFrame(rows_in, "CONSECUTIVE string, enfermedad string, COD_EVE int, place bigint, v string").withColumn(
            "place", F.col("place").cast(kind))
        got = dedupe.dedupe_cases(df, order_by=["place"], copies="n")
        assert got.columns == [*df.columns, "n"] and got.schema["place"].dataType == df.schema["place"].dataType
        assert sorted(map(str, ((r["CONSECUTIVE"], r["v"], r["place"] and int(r["place"]), r["n"]) for r in got.collect()))) == sorted(map(str, [
            (None, "a", 5, 2), ("SIN_DATO", "a", 2, 1), (None, "b", None, 2), ("9", "c", 1, 2)]))
