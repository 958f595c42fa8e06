"""Golden truth table of the rules without patterns and predictions."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import scoring

# fast timing, tab hidden, pastes -> base, combined, support, elevated, strong, risk, evidence confidence
TABLE = [
    (0, 0, 0, 0.0630, 0.0630, 0, 0, 0, "LOW", 0.0450),
    (0, 0, 1, 0.1680, 0.1680, 1, 0, 0, "LOW", 0.1400),
    (0, 0, 2, 0.2730, 0.2730, 1, 1, 1, "LOW", 0.3550),
    (0, 1, 0, 0.1163, 0.1163, 1, 0, 0, "LOW", 0.1150),
    (0, 1, 1, 0.3047, 0.3047, 2, 0, 0, "LOW", 0.2100),
    (0, 1, 2, 0.4597, 0.4597, 2, 1, 1, "MEDIUM", 0.4250),
    (0, 2, 0, 0.1697, 0.1697, 1, 1, 0, "LOW", 0.2263),
    (0, 2, 1, 0.3913, 0.3913, 2, 1, 0, "LOW", 0.3212),
    (0, 2, 2, 0.5463, 0.5463, 2, 2, 1, "MEDIUM", 0.5363),
    (0, 3, 0, 0.2230, 0.2230, 1, 1, 1, "LOW", 0.3550),
    (0, 3, 1, 0.4780, 0.4780, 2, 1, 1, "MEDIUM", 0.4500),
    (0, 3, 2, 0.6330, 0.6330, 2, 2, 2, "MEDIUM", 0.6650),
    (1, 0, 0, 0.2520, 0.2520, 1, 1, 1, "LOW", 0.3550),
    (1, 0, 1, 0.5070, 0.5070, 2, 1, 1, "MEDIUM", 0.4500),
    (1, 0, 2, 0.6620, 0.6620, 2, 2, 2, "MEDIUM", 0.6650),
    (1, 1, 0, 0.4387, 0.4387, 2, 1, 1, "LOW", 0.4250),
    (1, 1, 1, 0.5603, 0.5603, 3, 1, 1, "MEDIUM", 0.5200),
    (1, 1, 2, 0.7153, 0.7153, 3, 2, 2, "MEDIUM", 0.7000),
    (1, 2, 0, 0.5253, 0.5253, 2, 2, 1, "MEDIUM", 0.5363),
    (1, 2, 1, 0.6303, 0.6303, 3, 2, 1, "MEDIUM", 0.6312),
    (1, 2, 2, 0.7687, 0.7687, 3, 3, 2, "MEDIUM", 0.7500),
    (1, 3, 0, 0.6120, 0.6120, 2, 2, 2, "MEDIUM", 0.6650),
    (1, 3, 1, 0.7170, 0.7170, 3, 2, 2, "MEDIUM", 0.7250),
    (1, 3, 2, 0.8220, 0.8720, 3, 3, 3, "HIGH", 0.8000),
]


def test_truth_table(spark):
    rows = [(i, 5.0 if fast else 0.0, tab, paste) for i, (fast, tab, paste, *_) in enumerate(TABLE)]
    features = spark.createDataFrame(rows, "i int, time_per_question_mean_s double, tab_hidden_count long, paste_count long")
    out = scoring.combine_signals(scoring.detect_signals(features)).withColumns(
        {"pattern_strength": F.lit(0.0), "risk": scoring.assign_risk(F.col("combined_score"))}
    )
    got = out.withColumn("evidence", scoring.evidence_confidence()).orderBy("i").collect()
    for row, (_, _, _, base, combined, support, elevated, strong, risk, evidence) in zip(got, TABLE):
        assert row.base_score == pytest.approx(base, abs=6e-5)
        assert row.combined_score == pytest.approx(combined, abs=6e-5)
        assert (row.support_count, row.elevated_count, row.strong_count) == (support, elevated, strong)
        assert row.risk == risk
        assert row.evidence == pytest.approx(evidence, abs=6e-5)


def test_more_counts_change_nothing(spark):
    features = spark.createDataFrame(
        [(3, 2), (30, 20)], "tab_hidden_count long, paste_count long"
    ).withColumn("time_per_question_mean_s", F.lit(2.0))
    scores = scoring.combine_signals(scoring.detect_signals(features)).select("combined_score").collect()
    assert scores[0] == scores[1]
