"""Forest training: features, candidates, blend selection, bundle storage."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from casewatch import presets
from casewatch.functions import epi
from casewatch.operators import metrics
from casewatch.operators.align import require_columns
from casewatch.operators.encode import FeatureTable
from casewatch.operators.priors import Priors, apply_priors
from casewatch.operators.windows import ENTITY
from casewatch.session import materialize

KEY = [*ENTITY, "year", "month"]
LABEL, WEIGHT, RAW = "_label", "_weight", "_raw_prediction"


@dataclass(frozen=True)
class Candidate:
    """A forest configuration and the transform of its target."""

    name: str
    transform: str
    trees: int
    depth: int
    feature_share: float
    row_share: float


CANDIDATES = [Candidate(*row) for row in presets.FOREST_CANDIDATES]


@dataclass
class TrainedModel:
    """A fitted pipeline with all that scoring needs."""

    name: str
    pipeline: PipelineModel
    priors: Priors
    features: FeatureTable
    config: str
    transform: str
    blend: str
    rows: int
    validation: dict[str, float] = field(default_factory=dict)
    training: dict[str, float] = field(default_factory=dict)


@dataclass
class Bundle:
    """The global model and one model per disease with enough rows."""

    overall: TrainedModel
    by_disease: dict[str, TrainedModel]

    def models(self) -> list[TrainedModel]:
        return [self.overall, *self.by_disease.values()]


def feature_stages(features: FeatureTable) -> list:
    """One-hot vectors of the numbers a feature table gives, and the assembled input.

    An unseen category has the number after the last, which the encoder drops: all
    its indicator columns are zero. The encoder is fitted on the widths alone.
    """
    categorical = list(features.widths)
    stages = []
    if categorical:
        indexed, encoded = ([f"_{kind}_{c}" for c in categorical] for kind in ("idx", "hot"))
        spark = features.table.sparkSession
        widths = spark.createDataFrame([[float(features.widths[c]) for c in categorical]], ", ".join(f"`{c}` double" for c in indexed))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True).fit(widths))
    inputs = [*[f"_hot_{c}" for c in categorical], *[f"_num_{c}" for c in features.medians]]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features")]


def fit_features(train: DataFrame) -> FeatureTable:
    return FeatureTable.fit(train, presets.CATEGORICAL_FEATURES, presets.NUMERIC_FEATURES)


def numeric_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in presets.NUMERIC_FEATURES})


def fit_forest(train: DataFrame, candidate: Candidate, features: FeatureTable, seed: int = presets.SEED) -> PipelineModel:
    """Fit one weighted forest on prepared rows."""
    forest = RandomForestRegressor(
        featuresCol="_features", labelCol=LABEL, weightCol=WEIGHT, predictionCol=RAW,
        numTrees=candidate.trees, maxDepth=candidate.depth, seed=seed,
        featureSubsetStrategy=str(candidate.feature_share),
        subsamplingRate=candidate.row_share, minInstancesPerNode=1, maxMemoryInMB=512,
    )
    labelled = train.withColumns({
        LABEL: epi.transform_target(presets.TARGET, candidate.transform),
        WEIGHT: epi.sample_weight(presets.TARGET),
    })
    return Pipeline(stages=[*feature_stages(features), forest]).fit(labelled)


def predict_raw(df: DataFrame, model: PipelineModel, transform: str) -> DataFrame:
    """Model output of prepared rows on the original scale, never below zero, in ``_model``."""
    kept = df.columns
    scored = model.transform(df)
    value = F.greatest(epi.inverse_target(RAW, transform), F.lit(0.0))
    return scored.select(*kept, value.alias("_model"))


def score_candidates(
    train: DataFrame, test: DataFrame, candidates: list[Candidate], features: FeatureTable,
) -> list[dict]:
    """Every candidate with every blend: one fit and one aggregate per candidate."""
    results = []
    for candidate in candidates:
        model = fit_forest(train, candidate, features)
        scored = predict_raw(test, model, candidate.transform)
        rows = metrics.blend_scores(scored, presets.TARGET, "_model").orderBy("blend_order")
        # One row per blend preset: four in all.
        results += [{"candidate": candidate, **r.asDict()} for r in rows.collect()]
    return results


def select_best(results: list[dict]) -> dict:
    """Lowest selection score; the first wins a tie."""
    return min(results, key=lambda r: r["score"])


def split_panel(
    panel: DataFrame, rows: int, small_rows: int = presets.SMALL_PANEL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; a panel under ``small_rows`` rows gives a larger test share."""
    small = rows < small_rows
    share = presets.TEST_SHARE_SMALL if small else presets.TEST_SHARE
    marked = metrics.stratified_split(panel, KEY, test_share=share).drop("bin")
    marked = materialize(marked)
    return (
        marked.filter(~F.col("is_test")).drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def with_priors(panel: DataFrame, priors: Priors) -> DataFrame:
    """The panel with prior features, stored: features are fitted on it and applied to it."""
    return materialize(numeric_as_double(apply_priors(panel, priors)))


def train_one(
    panel: DataFrame, name: str, candidates: list[Candidate] = CANDIDATES
) -> TrainedModel:
    """Split, choose forest and blend on the held-out rows, refit on all rows.

    ``panel`` should be materialised: each fit reads it several times.
    """
    rows = panel.count()
    if rows < presets.MIN_TRAINING_ROWS:
        raise ValueError(f"not enough rows to train model {name}: {rows}")
    train, test = split_panel(panel, rows)
    priors = Priors.fit(train).stored()
    # The forest reads its input many times; the prior and category joins run once.
    known = with_priors(train, priors)
    features = fit_features(known)
    train_rows = materialize(features.apply(known), spread_by=KEY)
    test_rows = materialize(features.apply(with_priors(test, priors)))
    best = select_best(score_candidates(train_rows, test_rows, candidates, features))
    candidate: Candidate = best["candidate"]

    final_priors = Priors.fit(panel).stored()
    whole = with_priors(panel, final_priors)
    final_features = fit_features(whole)
    full = materialize(final_features.apply(whole), spread_by=KEY)
    pipeline = fit_forest(full, candidate, final_features)
    scored = predict_raw(full, pipeline, candidate.transform)
    mixed = scored.withColumn(
        "_blend", metrics.blend("_model", presets.BLENDS[best["blend"]], scored.columns)
    )
    training = metrics.evaluate(mixed, presets.TARGET, "_blend").head().asDict()
    return TrainedModel(
        name=name, pipeline=pipeline, priors=final_priors, features=final_features, config=candidate.name,
        transform=candidate.transform, blend=best["blend"], rows=rows,
        validation={m: best[m] for m in metrics.METRICS}, training=training,
    )


def model_names(panel: DataFrame, min_rows: int = presets.MIN_DISEASE_ROWS) -> DataFrame:
    """Model of each disease: its own with at least ``min_rows`` rows, else the global one."""
    counts = panel.groupBy("disease").agg(F.count(F.lit(1)).alias("training_rows"))
    own = F.when(F.col("training_rows") >= min_rows, F.col("disease"))
    return counts.withColumn("model_used", F.coalesce(own, F.lit(presets.GLOBAL_MODEL)))


def train_bundle(
    panel: DataFrame,
    candidates: list[Candidate] = CANDIDATES,
    per_disease: bool = True,
    min_rows: int = presets.MIN_DISEASE_ROWS,
    parallelism: int = 4,
) -> Bundle:
    """Global model and one per disease with at least ``min_rows`` rows.

    ``parallelism`` models are trained at a time, so that the short jobs of
    small diseases do not leave the cluster idle.
    """
    require_columns(panel, [*KEY, presets.TARGET])
    if panel.isEmpty():
        raise ValueError("no valid rows to build the training panel")
    overall = train_one(panel, presets.GLOBAL_MODEL, candidates)
    by_disease: dict[str, TrainedModel] = {}
    if per_disease:
        # One row per disease.
        own = model_names(panel, min_rows).filter("model_used = disease")
        names = [row["disease"] for row in own.orderBy("disease").collect()]

        @inheritable_thread_target(panel.sparkSession)
        def fit_one(name: str) -> TrainedModel:
            return train_one(panel.filter(F.col("disease") == name), name, candidates)

        with ThreadPool(parallelism) as pool:
            by_disease = dict(zip(names, pool.map(fit_one, names), strict=True))
    return Bundle(overall, by_disease)


def metrics_table(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """One row per model: configuration, blend, rows, both sets of metrics."""
    rows = [
        (
            m.name, m.config, m.blend, m.rows,
            *[float(m.validation[k]) for k in metrics.METRICS],
            *[float(m.training[k]) for k in metrics.METRICS],
        )
        for m in bundle.models()
    ]
    names = ", ".join(
        f"{stage}_{k} double" for stage in ("validation", "train") for k in metrics.METRICS
    )
    return spark.createDataFrame(
        rows, f"model string, best_config string, blend_config string, training_rows long, {names}"
    )


# --- storage -------------------------------------------------------------------

#: Bundles this process has loaded: by path, the version and the bundle.
_LOADED: dict[str, tuple[str, Bundle]] = {}


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Pipelines, prior and feature tables and one metadata row per model, under a new version."""
    rows, version = [], uuid.uuid4().hex
    for model in bundle.models():
        folder = f"{path}/models/{_slug(model.name)}"
        model.pipeline.write().overwrite().save(f"{folder}/pipeline")
        model.priors.base.write.mode("overwrite").parquet(f"{folder}/priors")
        model.features.table.write.mode("overwrite").parquet(f"{folder}/features")
        rows.append((
            model.name, model.config, model.transform, model.blend, model.rows,
            json.dumps(model.validation), json.dumps(model.training), version,
        ))
    kinds = (
        "name string, config string, transform string, blend string, rows long, "
        "validation string, training string, version string"
    )
    spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(f"{path}/metadata")
    metrics_table(spark, bundle).write.mode("overwrite").json(f"{path}/metrics")
    _LOADED.pop(path, None)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Stored bundle; kept in this process until another version is stored there."""
    metadata = spark.read.parquet(f"{path}/metadata").collect()  # one row per model
    version = metadata[0]["version"]
    if _LOADED.get(path, ("",))[0] != version:
        models = {}
        for row in metadata:
            folder = f"{path}/models/{_slug(row['name'])}"
            models[row["name"]] = TrainedModel(
                name=row["name"], pipeline=PipelineModel.load(f"{folder}/pipeline"),
                priors=Priors(spark.read.parquet(f"{folder}/priors")),
                features=FeatureTable.of(spark.read.parquet(f"{folder}/features")),
                config=row["config"], transform=row["transform"], blend=row["blend"],
                rows=row["rows"], validation=json.loads(row["validation"]),
                training=json.loads(row["training"]),
            )
        overall = models.pop(presets.GLOBAL_MODEL)
        _LOADED[path] = version, Bundle(overall, models)
    return _LOADED[path][1]
