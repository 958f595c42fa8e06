"""Feature matrices, training, prediction and refinement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import LABELS, HotKeys, PatternRules
from vigilframe.functions.scalar import fixed, map_risk, or_default
from vigilframe.operators.features import NO_PASTE_ANSWER_S, SEQUENCE_COLUMNS, attempt_features
from vigilframe.operators.timeline import Scan, on_timelines
from vigilframe.session import cut

# Columns of the two feature matrices, in training order.
SERVE_COLUMNS = (
    "paste_count",
    "tab_hidden_count",
    "idle_spike_count",
    "time_per_question",
    "questions_seen",
    "attempt_duration",
    "paste_per_question",
    "tab_per_question",
    "speed",
    "tab_density",
    "paste_density",
    "idle_ratio",
    "suspicious_combo",
    "fast_paste",
    "fast_tab",
)
REFINE_COLUMNS = (
    "paste_count",
    "tab_hidden_count",
    "idle_spike_count",
    "time_per_question_mean_s",
    "questions_seen",
    "attempt_duration_s",
    "paste_per_question",
    "tab_per_question",
    "speed",
    "tab_density",
    "paste_density",
    "idle_ratio",
    "suspicious_combo",
    "fast_paste",
    "fast_tab",
    *SEQUENCE_COLUMNS,
)
MOST_DEPTH = 30  # of MLlib's trees
LEAK_COLUMNS = ("timing_score", "tab_score", "clipboard_score")


def _matrix(
    rows: DataFrame, time: Column, questions: Column, duration: Column, names: tuple[str, str], keep: Sequence[str]
) -> DataFrame:
    """The fifteen base columns, given how time, questions and duration treat missing data."""
    time_name, duration_name = names
    count = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    base = rows.withColumns(
        {
            "_t": time.cast("double"),
            "_q": questions.cast("double"),
            "_d": duration.cast("double"),
            "_p": count("paste_count"),
            "_h": count("tab_hidden_count"),
            "_i": count("idle_spike_count"),
        }
    ).withColumns(
        {
            "_ppq": F.col("_p") / F.col("_q"),
            "_hpq": F.col("_h") / F.col("_q"),
            "_s": 1.0 / (F.col("_t") + 1e-5),
        }
    )
    span = F.col("_d") + 1e-5
    return base.select(
        *keep,
        F.col("_p").alias("paste_count"),
        F.col("_h").alias("tab_hidden_count"),
        F.col("_i").alias("idle_spike_count"),
        F.col("_t").alias(time_name),
        F.col("_q").alias("questions_seen"),
        F.col("_d").alias(duration_name),
        F.col("_ppq").alias("paste_per_question"),
        F.col("_hpq").alias("tab_per_question"),
        F.col("_s").alias("speed"),
        (F.col("_h") / span).alias("tab_density"),
        (F.col("_p") / span).alias("paste_density"),
        (F.col("_i") / F.col("_q")).alias("idle_ratio"),
        (F.col("_ppq") * F.col("_hpq")).alias("suspicious_combo"),
        (F.col("_s") * F.col("_ppq")).alias("fast_paste"),
        (F.col("_s") * F.col("_hpq")).alias("fast_tab"),
    )


def _known(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def serve_features(features: DataFrame, keep: Sequence[str] = ("attempt_id",)) -> DataFrame:
    """Matrix for prediction: zero time, questions or duration count as 1."""
    one = lambda c: or_default(F.col(c).cast("double"), 1.0)
    return _matrix(
        features,
        one("time_per_question_mean_s"),
        one("questions_seen"),
        one("attempt_duration_s"),
        ("time_per_question", "attempt_duration"),
        keep,
    )


def train_features(log: DataFrame, keep: Sequence[str] = ("attempt_id",)) -> DataFrame:
    """Matrix for training from logged rows: zero duration stays zero, unknown risks are dropped."""
    labelled = log.withColumn("risk", map_risk(F.col("risk"))).where("risk IS NOT NULL")
    return _matrix(
        labelled,
        or_default(F.col("time_per_question_mean_s").cast("double"), 1.0),
        F.greatest(_known("questions_seen", 1.0), F.lit(1.0)),
        _known("attempt_duration_s", 1.0),
        ("time_per_question", "attempt_duration"),
        (*keep, "risk"),
    )


def refine_features(features: DataFrame, keep: Sequence[str] = ("attempt_id",)) -> DataFrame:
    """Matrix of the refiner: floors instead of defaults, plus the sequence features."""
    default = lambda c: NO_PASTE_ANSWER_S if c == "paste_to_answer_seconds_min" else 0.0
    have = {c: _known(c, default(c)) if c in features.columns else F.lit(default(c)) for c in SEQUENCE_COLUMNS}
    return _matrix(
        features.withColumns(have),
        F.greatest(_known("time_per_question_mean_s", 1.0), F.lit(0.001)),
        F.greatest(_known("questions_seen", 1.0), F.lit(1.0)),
        F.greatest(_known("attempt_duration_s", 1.0), F.lit(1.0)),
        ("time_per_question_mean_s", "attempt_duration_s"),
        (*keep, *SEQUENCE_COLUMNS),
    ).select(*keep, *REFINE_COLUMNS)


def rebuild_refine_dataset(
    events: DataFrame,
    labels: DataFrame,
    sequences: bool = False,
    rules: PatternRules = PatternRules(),
    limits: HotKeys = HotKeys(),
) -> DataFrame:
    """Refiner rows of labelled attempts; HIGH is left out. Labels: (attempt_id, expected_label)."""
    label = F.trim(F.upper(F.col("expected_label")))
    wanted = labels.select("attempt_id", label.alias("label")).where(F.col("label").isin("LOW", "MEDIUM"))
    features = attempt_features(events, rules, sequences=sequences, limits=limits)
    return refine_features(features.join(wanted, "attempt_id"), keep=("attempt_id", "label"))


def clean_training_set(rows: DataFrame, label: str = "risk") -> DataFrame:
    """Integer label, no incomplete rows, no leaking columns."""
    number = F.expr(f"try_cast(`{label}` AS DOUBLE)").cast("int")
    return rows.withColumn(label, number).na.drop().drop(*LEAK_COLUMNS)


def stratified_split(
    rows: DataFrame, label: str, row_id: str, train: float, seed: int, limits: HotKeys = HotKeys()
) -> tuple[DataFrame, DataFrame]:
    """Split with the same label shares on both sides; the same rows always land on the same side."""
    totals = rows.groupBy(label).agg(F.count("*").alias("_n"))
    if totals.count() <= limits.broadcast_rows:
        totals = F.broadcast(totals)
    ranked = on_timelines(
        rows.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed))),
        lambda t: t.scan(Scan("_rank", "sum", F.lit(1).cast("long"), here=True), order=("_h", row_id)).rows,
        key=(label,),
        limits=limits,
        order=("_h", row_id),
    ).join(totals, label)
    is_train = F.col("_rank") <= F.round(F.col("_n") * train)
    side = lambda keep: ranked.where(keep).drop("_h", "_rank", "_n")
    return side(is_train), side(~is_train)


def fit_scaler(rows: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (constant columns scale by 1)."""
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0) for c in columns}


def scale_features(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - mean) / std for c, (mean, std) in scaler.items()})


def _stages(columns: Sequence[str], scaled: bool) -> list:
    assembler = VectorAssembler(inputCols=list(columns), outputCol="assembled", handleInvalid="skip")
    if not scaled:
        return [assembler.setOutputCol("features")]
    return [assembler, StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True)]


def train_risk_forest(
    train: DataFrame, columns: Sequence[str] = SERVE_COLUMNS, label: str = "risk", trees: int = 100, seed: int = 42
) -> PipelineModel:
    """Random forest on LOW, MEDIUM and HIGH."""
    forest = RandomForestClassifier(
        labelCol=label,
        numTrees=trees,
        maxDepth=4,
        minInstancesPerNode=5,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    return Pipeline(stages=[*_stages(columns, scaled=True), forest]).fit(train)


def _weighted(train: DataFrame, label: str) -> DataFrame:
    return train.withColumn("_weight", F.when(F.col(label) == 1, 1.25).otherwise(1.0))


def train_refine_logistic(
    train: DataFrame, columns: Sequence[str] = REFINE_COLUMNS, label: str = "label"
) -> PipelineModel:
    """Logistic regression LOW against MEDIUM, MEDIUM weighted 1.25, unit L2 penalty."""
    weighted = _weighted(train, label)
    total = weighted.agg(F.sum("_weight")).first()[0] or 1.0
    model = LogisticRegression(
        labelCol=label,
        weightCol="_weight",
        maxIter=200,
        regParam=1.0 / total,
        elasticNetParam=0.0,
        standardization=False,
    )
    return Pipeline(stages=[*_stages(columns, scaled=True), model]).fit(weighted)


@dataclass(frozen=True)
class LogisticWeights:
    """A fitted logistic regression: the constant, then a weight for each standardised column."""

    columns: tuple[str, ...]
    scaler: dict[str, tuple[float, float]]
    weights: tuple[float, ...]
    moved: float  # largest change of a weight in the last step

    def probability(self) -> Column:
        x = _standardised(self.columns, self.scaler)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-_dot(x, self.weights)))

    def rows(self, spark) -> DataFrame:
        pairs = list(zip(("intercept", *self.columns), self.weights))
        return spark.createDataFrame(pairs, "feature string, weight double")


def _standardised(columns: Sequence[str], scaler: dict[str, tuple[float, float]]) -> Column:
    """1 and the scaled columns as an array; a constant column is 0."""
    scaled = [(F.col(c) - scaler[c][0]) / scaler[c][1] if scaler[c][1] else F.lit(0.0) for c in columns]
    return F.array(F.lit(1.0), *scaled)


def _dot(x: Column, weights: Sequence[float]) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def newton_logistic(
    train: DataFrame,
    columns: Sequence[str] = REFINE_COLUMNS,
    label: str = "label",
    positive_weight: float = 1.25,
    penalty: float = 1.0,
    steps: int = 10,
) -> LogisticWeights:
    """Logistic regression by Newton steps, with an L2 penalty on all weights but the constant.

    A step is one aggregate over the rows: the sums of x x' w p (1 - p) and of x w (y - p), columns squared numbers
    whatever the number of rows. The rows are pinned once as arrays. Rows with a null in a column don't count.
    """
    known = train.where(F.col(label).isin(0, 1)).na.drop(subset=list(columns))
    stats = known.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    ).first()
    scaler = {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0) for c in columns}
    weight = F.when(F.col(label) == 1, positive_weight).otherwise(1.0)
    rows = cut(known.select(_standardised(columns, scaler).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w")))
    size = len(columns) + 1
    weights, moved = np.zeros(size), 0.0
    hold = np.array([0.0, *[penalty] * (size - 1)])
    for _ in range(steps if stats["n"] else 0):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-_dot(F.col("x"), weights)))
        seen = rows.withColumn("p", p).withColumn("curve", F.col("w") * F.col("p") * (1 - F.col("p")))
        outer = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b * F.col("curve"))))
        slope = F.transform("x", lambda a: a * F.col("w") * (F.col("y") - F.col("p")))
        both = seen.select(array_to_vector(F.concat(outer, slope)).alias("v"))
        sums = both.agg(Summarizer.sum(F.col("v")).alias("s")).first()["s"].toArray()
        curves = sums[: size * size].reshape(size, size) + np.diag(hold)
        if not np.linalg.cond(curves) < 1e15:
            break
        step = np.linalg.solve(curves, sums[size * size :] - hold * weights)
        weights, moved = weights + step, float(np.abs(step).max())
    return LogisticWeights(tuple(columns), scaler, tuple(weights.tolist()), moved)


def train_refine_forest(
    train: DataFrame,
    columns: Sequence[str] = REFINE_COLUMNS,
    label: str = "label",
    trees: int = 200,
    depth: int = MOST_DEPTH,
    seed: int = 23,
) -> PipelineModel:
    """Comparison forest on unscaled features, grown as deep as MLlib allows."""
    forest = RandomForestClassifier(
        labelCol=label,
        weightCol="_weight",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    return Pipeline(stages=[*_stages(columns, scaled=False), forest]).fit(_weighted(train, label))


def feature_importance(model: PipelineModel, spark, columns: Sequence[str] = SERVE_COLUMNS) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(w)) for c, w in zip(columns, weights)], "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """A saved model; none if there is no such path, which means: no predictions."""
    try:
        return PipelineModel.load(path)
    except AnalysisException:
        return None
    except Exception as e:  # the loader reports a missing path through the JVM
        if "does not exist" in str(e):
            return None
        raise


def predict_risk(model: PipelineModel | None, matrix: DataFrame) -> DataFrame | None:
    """Label, probability per label and confidence of each attempt; no model gives no predictions."""
    if model is None:
        return None
    p = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in LABELS])
    return (
        model.transform(matrix)
        .withColumn("_p", p)
        .select(
            "attempt_id",
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("ml_risk"),
            F.array_max("_p").alias("ml_confidence"),
            F.map_from_arrays(F.slice(names, 1, F.size("_p")), F.col("_p")).alias("probabilities"),
        )
    )


def predictor(model: PipelineModel | None):
    """The model as a step of a scoring plan: adds ml_risk and ml_confidence to feature rows.

    It works on the rows themselves, so nothing is joined; without a model every row gets LOW and 0.
    """

    def add(rows: DataFrame) -> DataFrame:
        if model is None:
            return rows.withColumns({"ml_risk": F.lit("LOW"), "ml_confidence": F.lit(0.0)})
        names = F.array(*[F.lit(x) for x in LABELS])
        held = rows.withColumn("_row", F.struct(*rows.columns))
        return model.transform(serve_features(held, keep=("_row",))).select(
            "_row.*",
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("ml_risk"),
            F.array_max(vector_to_array("probability")).alias("ml_confidence"),
        )

    return add


def predict_medium(model: PipelineModel | None, matrix: DataFrame) -> DataFrame | None:
    """Probability of MEDIUM of each attempt from a refiner."""
    if model is None:
        return None
    return model.transform(matrix).select("attempt_id", vector_to_array("probability")[1].alias("p_medium"))


def refine_low_medium(rows: DataFrame, missing: str = "no model") -> DataFrame:
    """Move borderline attempts between LOW and MEDIUM by ``p_medium`` (null: no prediction).

    Needs risk, combined_score and the feature columns; adds refined_risk, note and used_p_medium.
    """
    some = lambda c: (F.col(c) if c in rows.columns else F.lit(0)) > 0
    advanced = reduce(
        lambda a, b: a | b,
        [
            F.coalesce(some(c), F.lit(False))
            for c in (
                "suspicious_sequence_count",
                "paste_to_answer_fast_count",
                "tab_return_fast_answer_count",
                "answer_burst_count",
                "idle_to_activity_burst_count",
            )
        ],
    )
    risk = F.trim(F.upper(F.coalesce("risk", F.lit(""))))
    score, p = F.coalesce("combined_score", F.lit(0.0)), F.col("p_medium")
    time = F.coalesce("time_per_question_mean_s", F.lit(0.0))
    suspicious = (
        (F.coalesce("paste_count", F.lit(0)) > 0)
        | (F.coalesce("tab_hidden_count", F.lit(0)) > 0)
        | ((time > 0) & (time < 12))
        | F.col("_advanced")
    )
    promote = (
        (p >= F.when(F.col("_advanced"), 0.62).otherwise(0.65))
        & suspicious
        & (score >= F.when(F.col("_advanced"), 0.15).otherwise(0.25))
    )
    shown = fixed(p, 2)

    def text(before: str, after: str) -> Column:
        return F.concat(F.lit(f"ML refinement {before} (p_medium="), shown, F.lit(f"){after}."))

    step = (
        F.when(risk == "HIGH", "high")
        .when(~risk.isin("LOW", "MEDIUM"), "unknown")
        .when((risk == "LOW") & (score < 0.20) & ~F.col("_advanced"), "far")
        .when((risk == "MEDIUM") & (score > 0.70), "sure")
        .when(p.isNull(), "no_model")
        .when((risk == "LOW") & promote, "promote")
        .when(risk == "LOW", "keep_low")
        .when((p <= 0.35) & (score <= 0.55), "demote")
        .otherwise("keep_medium")
    )
    # Notes of the refinement.
    notes = {
        "high": F.lit("Rule risk is HIGH; ML refinement skipped."),
        "unknown": F.lit("Unknown current risk; ML refinement skipped."),
        "far": F.lit("Combined score far below MEDIUM; ML refinement skipped."),
        "sure": F.lit("Combined score strongly MEDIUM; ML refinement skipped."),
        "no_model": F.lit(f"ML refinement unavailable: {missing}."),
        "promote": text("promoted LOW→MEDIUM", " for borderline suspicious behavior"),
        "keep_low": text("kept LOW", ""),
        "demote": text("demoted MEDIUM→LOW", " due to weak suspicious evidence"),
        "keep_medium": text("kept MEDIUM", ""),
    }
    note = reduce(lambda acc, kv: acc.when(F.col("_step") == kv[0], kv[1]), notes.items(), F.when(F.lit(False), ""))
    return (
        rows.withColumn("_advanced", advanced)
        .withColumn("_step", step)
        .withColumns(
            {
                "refined_risk": F.when(F.col("_step") == "promote", "MEDIUM")
                .when(F.col("_step") == "demote", "LOW")
                .when(F.col("_step") == "unknown", F.col("risk"))
                .otherwise(risk),
                "note": note,
                "used_p_medium": F.when(
                    F.col("_step").isin("promote", "keep_low", "demote", "keep_medium"), p
                ),
            }
        )
        .drop("_advanced", "_step")
    )
