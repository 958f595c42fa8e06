import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from vigilframe.catalog import QUERIES, RULES, events, labels, scored
from vigilframe.operators import learning
from vigilframe.plans.score import score_attempts
from vigilframe.session import cut, fresh_path


@pytest.fixture(scope="module")
def matrix(spark):
    return cut(learning.train_features(scored(spark, SMALL)))


@pytest.fixture(scope="module")
def forest(matrix):
    return learning.train_risk_forest(matrix, trees=10)


def test_predictions(spark, forest):
    rows = scored(spark, SMALL)
    got = learning.predict_risk(forest, learning.serve_features(rows)).collect()
    assert len(got) == rows.count()
    for r in got:
        assert sum(r.probabilities.values()) == pytest.approx(1.0)
        assert r.ml_confidence == pytest.approx(max(r.probabilities.values()))
        assert r.ml_risk in ("LOW", "MEDIUM", "HIGH")


def test_saved_model_predicts_the_same(spark, forest, matrix):
    path = fresh_path(spark, "t_model")
    learning.save_model(forest, path)
    a, b = (learning.predict_risk(m, matrix).orderBy("attempt_id").select("ml_risk", "ml_confidence").collect() for m in (forest, learning.load_model(path)))
    assert a == b


def test_missing_model_means_no_predictions(spark):
    assert learning.load_model(fresh_path(spark, "t_absent")) is None
    rows = score_attempts(events(spark, SMALL), patterns=RULES, predictions=learning.predict_risk(None, None))
    assert rows.where("ml_risk <> 'LOW' OR ml_confidence <> 0").isEmpty()


def test_predictions_move_the_decision(spark, forest):
    rows = scored(spark, SMALL)
    sure = rows.select("attempt_id", F.lit("HIGH").alias("ml_risk"), F.lit(0.9).alias("ml_confidence"))
    lifted = score_attempts(events(spark, SMALL), patterns=RULES, predictions=sure)
    both = rows.select("attempt_id", F.col("risk").alias("before")).join(lifted, "attempt_id")
    assert both.where("before = 'MEDIUM' AND NOT (risk = 'HIGH' AND promoted_by_pattern)").isEmpty()
    assert both.where("before = 'LOW' AND risk <> 'LOW'").isEmpty()


def test_importance_names_every_feature(spark, forest):
    rows = learning.feature_importance(forest, spark).collect()
    assert [r.feature for r in rows] == list(learning.SERVE_COLUMNS)
    assert sum(r.importance for r in rows) == pytest.approx(1.0)


def test_scaled_columns(matrix):
    scaled = learning.scale_features(matrix, learning.fit_scaler(matrix, learning.SERVE_COLUMNS))
    row = scaled.agg(F.avg("speed").alias("m"), F.stddev_pop("speed").alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)


def test_refiner(spark):
    rows = learning.rebuild_refine_dataset(events(spark, SMALL), labels(spark, SMALL), sequences=True, rules=RULES)
    rows = cut(rows.withColumn("label", F.when(F.col("label") == "MEDIUM", 1).otherwise(0)))
    p = learning.predict_medium(learning.train_refine_logistic(rows), rows)
    assert p.where("p_medium < 0 OR p_medium > 1 OR p_medium IS NULL").isEmpty()
    assert p.count() == rows.count()


def test_newton_steps_and_mllib_agree(spark):
    rows = learning.rebuild_refine_dataset(events(spark, SMALL), labels(spark, SMALL), sequences=True, rules=RULES)
    rows = cut(rows.withColumn("label", F.when(F.col("label") == "MEDIUM", 1).otherwise(0)))
    columns = learning.REFINE_COLUMNS[:12]
    model = learning.newton_logistic(rows, columns)
    assert model.moved < 1e-9 and len(model.weights) == 13
    other = learning.train_refine_logistic(rows, columns)
    both = other.transform(rows).select(learning.vector_to_array("probability")[1].alias("a"), model.probability().alias("b"))
    assert both.where("abs(a - b) > 1e-3").isEmpty()
    assert model.weights[1:] == pytest.approx(other.stages[-1].coefficients.toArray().tolist(), abs=2e-3)
    nothing = learning.newton_logistic(rows.limit(0), columns)
    assert nothing.weights == (0.0,) * 13


@pytest.mark.parametrize("name", ["train_risk_forest", "predict_risk", "train_refine_logistic"])
def test_a_constant_model_turns_its_row_red(spark, monkeypatch, name):
    """What the queries say of a model is not true of every model."""
    said = QUERIES[name](spark, SMALL).collect()[0].asDict()
    real_risk, real_medium = learning.predict_risk, learning.predict_medium
    monkeypatch.setattr(learning, "predict_risk", lambda m, x: real_risk(m, x).withColumns({"ml_risk": F.lit("LOW"), "ml_confidence": F.lit(1.0)}))
    monkeypatch.setattr(learning, "predict_medium", lambda m, x: real_medium(m, x).withColumn("p_medium", F.lit(0.5)))
    assert QUERIES[name](spark, SMALL).collect()[0].asDict() != said


CASES = [
    # risk, score, p, paste, advanced -> refined, used
    ("HIGH", 0.9, 0.1, 0, 0, "HIGH", None),
    ("odd", 0.5, 0.9, 0, 0, "odd", None),
    ("LOW", 0.19, 0.9, 3, 0, "LOW", None),
    ("LOW", 0.19, 0.63, 0, 1, "MEDIUM", 0.63),
    ("LOW", 0.14, 0.9, 0, 1, "LOW", 0.9),
    ("LOW", 0.3, 0.64, 1, 0, "LOW", 0.64),
    ("LOW", 0.3, 0.65, 1, 0, "MEDIUM", 0.65),
    ("LOW", 0.3, 0.99, 0, 0, "LOW", 0.99),
    ("MEDIUM", 0.71, 0.1, 0, 0, "MEDIUM", None),
    ("MEDIUM", 0.55, 0.35, 0, 0, "LOW", 0.35),
    ("MEDIUM", 0.56, 0.1, 0, 0, "MEDIUM", 0.1),
    (" medium", 0.5, 0.2, 0, 0, "LOW", 0.2),
    ("MEDIUM", 0.5, None, 0, 0, "MEDIUM", None),
]


def test_refinement_rules(spark):
    rows = spark.createDataFrame(
        [(i, r, s, p, c, a) for i, (r, s, p, c, a, *_) in enumerate(CASES)],
        "i int, risk string, combined_score double, p_medium double, paste_count long, suspicious_sequence_count long",
    ).withColumns({"tab_hidden_count": F.lit(0), "time_per_question_mean_s": F.lit(0.0)})
    got = learning.refine_low_medium(rows).orderBy("i").collect()
    assert [(r.refined_risk, r.used_p_medium) for r in got] == [c[-2:] for c in CASES]
    assert all(r.note for r in got)
