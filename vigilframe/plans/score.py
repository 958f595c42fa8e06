"""The flagship plan: attempts scored from their events.

One exchange on the attempt (plus a counting pass for hot attempts), windows on that partitioning,
one aggregation, then expressions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HotKeys, PatternRules, ScoringRules
from vigilframe.operators import scoring
from vigilframe.operators.explain import NO_DATA, NO_DATA_REASON, explain, explanation_text
from vigilframe.operators.features import FEATURE_COLUMNS, attempt_features
from vigilframe.operators.patterns import summarise_patterns

RESULT_COLUMNS = (
    "attempt_id",
    "risk",
    "confidence",
    "confidence_score",
    "promoted_by_pattern",
    "base_score",
    "combined_score",
    "pattern_count",
    "pattern_strength",
    "explanation_text",
)


def join_predictions(rows: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Add ``ml_risk`` and ``ml_confidence``; an attempt without prediction gets LOW and 0."""
    if predictions is None:
        return rows.withColumns({"ml_risk": F.lit("LOW"), "ml_confidence": F.lit(0.0)})
    side = predictions.select("attempt_id", "ml_risk", "ml_confidence")
    return rows.join(side, "attempt_id", "left").withColumns(
        {
            "ml_risk": F.coalesce("ml_risk", F.lit("LOW")),
            "ml_confidence": F.coalesce("ml_confidence", F.lit(0.0)),
        }
    )


Predict = Callable[[DataFrame], DataFrame]


def decide(
    features: DataFrame,
    rules: ScoringRules = ScoringRules(),
    patterns: PatternRules = PatternRules(),
    predictions: DataFrame | None = None,
    predict: Predict | None = None,
) -> DataFrame:
    """From feature rows to decisions, confidences and explanations. No exchange without predictions.

    ``predict`` is a model at work: it adds ``ml_risk`` and ``ml_confidence`` to the rows it is given (see
    ``learning.predictor``), so they need no second pass and no join.
    """
    rows = scoring.combine_signals(scoring.detect_signals(features, rules), rules)
    rows = summarise_patterns(rows, patterns)
    rows = rows.withColumn("low_data", scoring.is_low_data(rules)).withColumn(
        "rule_risk", scoring.assign_risk(F.col("combined_score"), rules)
    )
    rows = settled(rows, [c for c in rows.columns if c not in features.columns])
    rows = predict(rows) if predict else join_predictions(rows, predictions)
    rows = scoring.promote_by_pattern(rows, rules)
    rows = scoring.hybrid_decision(rows, rules).withColumns(
        {
            "confidence": scoring.rule_confidence(rules),
            "confidence_score": scoring.blend_confidence(
                scoring.evidence_confidence(rules), F.col("ml_confidence"), rules
            ),
        }
    )
    return low_data_guard(explanation_text(explain(rows, rules)))


def settled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Compute these columns here, once.

    A filter on the decision would otherwise be pushed below it by substituting every definition
    into it, and the predicate would hold thousands of copies of the score expressions. Filters on
    all other columns still pass.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*columns))))


def low_data_guard(rows: DataFrame) -> DataFrame:
    """Attempts without any data keep the features but get a fixed LOW result."""
    low = F.col("low_data")
    fixed = {
        "risk": F.lit("LOW"),
        "confidence": F.lit(0.1),
        "confidence_score": F.lit(0.1),
        "promoted_by_pattern": F.lit(False),
        "base_score": F.lit(0.0),
        "combined_score": F.lit(0.0),
        "summary": F.array(F.lit("Risk=LOW."), F.lit(NO_DATA)),
        "reasons": F.array(F.lit(NO_DATA_REASON)),
        "explanation_text": F.lit(NO_DATA),
    }
    return rows.withColumns({n: F.when(low, v).otherwise(F.col(n)) for n, v in fixed.items()})


def score_attempts(
    events: DataFrame,
    rules: ScoringRules = ScoringRules(),
    patterns: PatternRules = PatternRules(),
    predictions: DataFrame | None = None,
    extended: bool = False,
    passthrough: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
    limits: HotKeys = HotKeys(),
    predict: Predict | None = None,
) -> DataFrame:
    """One result row per attempt: result, feature and signal columns."""
    features = attempt_features(
        events, patterns, extended=extended, passthrough=passthrough, extra=extra, limits=limits
    )
    return decide(features, rules, patterns, predictions, predict)


def score_summary(results: DataFrame) -> DataFrame:
    """The five columns of the scoring answer; its confidence is the evidence score."""
    return results.select(
        "attempt_id",
        "risk",
        F.col("confidence_score").alias("confidence"),
        "combined_score",
        F.col("explanation_text").alias("explanation"),
    )


def feature_struct():
    return F.struct(*FEATURE_COLUMNS)
