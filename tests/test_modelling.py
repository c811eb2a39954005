"""Training, storage, routing and scoring with very small forests."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewatch import presets
from casewatch.operators.encode import FeatureTable
from casewatch.operators.panel import climate_features
from casewatch.operators.windows import temporal_features
from casewatch.plans import nodes, score, train
from casewatch.session import materialize, scratch_path

TINY = [train.Candidate("sqrt_4", "sqrt", 4, 4, 0.85, 1.0), train.Candidate("log_4", "log1p", 4, 4, 0.85, 1.0)]


@pytest.fixture(scope="module")
def panel(spark):
    places = spark.range(12).select(
        F.when(F.col("id") < 10, "Dengue").otherwise("Malaria").alias("disease"),
        F.when(F.col("id") % 2 == 0, "CHOCO").otherwise("VALLE").alias("department"),
        F.concat(F.lit("CITY_"), F.col("id").cast("string")).alias("municipality"),
        F.lit(2023).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "id",
    )
    rows = places.select(
        "disease", "department", "municipality", "year", "month",
        F.pmod(F.col("id") * 3 + F.col("month"), F.lit(9)).cast("double").alias("total_cases"),
    )
    return materialize(climate_features(temporal_features(rows)))


@pytest.fixture(scope="module")
def bundle(panel):
    return train.train_bundle(panel, TINY, min_rows=100)


def test_bundle(spark, bundle, panel):
    assert list(bundle.by_disease) == ["Dengue"]
    assert bundle.overall.rows == 144 and bundle.by_disease["Dengue"].rows == 120
    table = train.metrics_table(spark, bundle)
    assert table.count() == 2 and table.filter("train_mae < 0").count() == 0


def test_same_seed_same_model(bundle, panel):
    again = train.train_one(panel, "GLOBAL", TINY)
    assert again.validation == bundle.overall.validation


def test_first_candidate_wins_ties():
    rows = [{"candidate": "a", "score": 1.0}, {"candidate": "b", "score": 1.0}]
    assert train.select_best(rows)["candidate"] == "a"


def test_predict_routes_and_bounds(spark, bundle):
    asked = spark.createDataFrame(
        [("DENGUE", "Chocó", "city_0", 1), ("malaria", "Valle", "CITY_11", 7),
         ("zika", "nowhere", "nothing", 12)],
        "disease string, department string, municipality string, month int",
    )
    got = {r["disease"]: r for r in score.predict(asked, bundle).collect()}
    assert got["Dengue"]["model_used"] == "Dengue" and got["Dengue"]["department"] == "CHOCO"
    assert got["Malaria"]["model_used"] == got["Zika"]["model_used"] == "GLOBAL"
    assert all(r["estimated_cases"] >= 0 for r in got.values())
    assert got["Dengue"]["thermal_floor"] == "calido"
    assert got["Zika"]["thermal_floor"] == presets.DEFAULT_CLIMATE[0]


def test_month_out_of_range(spark, bundle):
    asked = spark.createDataFrame(
        [("Dengue", "CHOCO", "CITY_0", 13)],
        "disease string, department string, municipality string, month int",
    )
    with pytest.raises(PySparkException, match="month must be between"):
        score.predict(asked, bundle).collect()


def test_too_few_rows(panel):
    with pytest.raises(ValueError, match="not enough rows"):
        train.train_one(panel.limit(9), "small", TINY)


def test_empty_panel(panel):
    with pytest.raises(ValueError):
        train.train_bundle(panel.filter("false"), TINY)


def test_save_load_publish(spark, bundle):
    path = scratch_path(spark)
    train.save_bundle(spark, bundle, path)
    loaded = train.load_bundle(spark, path)
    assert train.load_bundle(spark, path) is loaded
    cases = spark.createDataFrame(
        [("DENGUE", "CHOCO", "CITY_0"), ("DENGUE", "Choco", "city_0"), ("MALARIA", "VALLE", "CITY_11"),
         ("DENGUE", "SIN_DATO", "X")],
        "enfermedad string, Departamento_ocurrencia string, Municipio_ocurrencia string",
    )
    table = score.publish(cases, loaded, f"{path}/v1", f"{path}/audit")
    assert table.count() == 24 and table.columns == presets.PREDICTION_COLUMNS
    assert spark.read.parquet(f"{path}/audit").head()["prediction_rows"] == 24
    again = score.publish(cases, loaded, f"{path}/v2", f"{path}/audit", current=table)
    assert again.exceptAll(table).isEmpty() and again.count() == 24


def test_unseen_category_is_all_zero(spark, panel):
    rows = panel.select("disease")
    fitted = FeatureTable.fit(rows, ["disease"], [])
    encoder = train.feature_stages(fitted)[0]
    odd = encoder.transform(fitted.apply(spark.createDataFrame([("Other",)], "disease string"))).head()
    assert odd["_hot_disease"].numNonzeros() == 0


def test_feature_table_is_exact(spark):
    rows = [("b", 1.0, None), ("a", 2.0, None), ("b", 10.0, None), ("c", None, None), (None, float("nan"), None)]
    df = spark.createDataFrame(rows, "name string, x double, empty int")
    fitted = FeatureTable.fit(df.filter("x IS NULL OR NOT isnan(x)"), ["name"], ["x", "empty"])
    assert fitted.modes == {"name": "b"} and fitted.widths == {"name": 3}
    assert fitted.medians == {"x": 2.0, "empty": 0.0}
    got = {(r["name"], r["x"]): (r["_idx_name"], r["_num_x"], r["_num_empty"]) for r in fitted.apply(df.fillna(0.5, ["x"])).collect()}
    assert got["b", 1.0] == (0.0, 1.0, 0.0) and got["a", 2.0] == (1.0, 2.0, 0.0) and got["c", 0.5][0] == 2.0
    assert {r["_idx_name"] for r in fitted.apply(df.filter("name IS NULL")).collect()} == {0.0}
    again = FeatureTable.of(fitted.table)
    assert (again.modes, again.medians, again.widths) == (fitted.modes, fitted.medians, fitted.widths)


def test_a_rewritten_bundle_is_loaded_anew(spark, bundle):
    path = scratch_path(spark)
    train.save_bundle(spark, bundle, path)
    first = train.load_bundle(spark, path)
    held = dict(train._LOADED)
    train.save_bundle(spark, bundle, path)
    train._LOADED.update(held)  # as another process has it
    assert train.load_bundle(spark, path) is not first


def test_node_table_scores_as_the_model(spark, bundle, panel):
    model = bundle.overall
    ready = materialize(model.features.apply(train.with_priors(panel, model.priors)))
    scored = materialize(model.pipeline.transform(ready).select(*train.KEY, "_features", train.RAW))
    table = materialize(nodes.node_table(spark, model.pipeline.stages[-1]))
    got = nodes.score_by_nodes(scored, table, train.KEY, 4).join(scored, train.KEY)
    assert got.count() == 144 and got.filter(F.abs(F.col("_by_nodes") - F.col(train.RAW)) > 1e-9).isEmpty()
    assert nodes.unbalanced(table).isEmpty()
    broken = table.withColumn("weight", F.when((F.col("node") == 1), F.col("weight") + 1).otherwise(F.col("weight")))
    assert not nodes.unbalanced(broken).isEmpty()
    # Both kinds of splits occur, and roots hold all rows of their sample.
    assert not table.filter("cut IS NOT NULL").isEmpty()
    assert table.filter("node = 0").count() == 4
