"""Signals, combination, decision and confidences: column expressions, no shuffle.

All functions add columns to a frame that has the feature columns, so the batch plan (one row per
attempt) and the progressive plan (one row per event) share them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import ScoringRules
from vigilframe.functions.scalar import clamp01, or_default


def _count_at_least(names, bound: float) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(f"{n}_score") >= bound).cast("int") for n in names])


def detect_signals(features: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """Six scores; a mean time of zero means that nothing was timed."""
    avg = or_default(F.col("time_per_question_mean_s"), rules.no_timing_s)
    return features.withColumn("avg_time", F.coalesce(avg, F.lit(rules.no_timing_s))).withColumns(
        {
            "timing_score": F.when(F.col("avg_time") < rules.fast_mean_s, 1.0).otherwise(0.1),
            "tab_score": F.least(F.lit(1.0), F.coalesce("tab_hidden_count", F.lit(0)) / rules.tab_full),
            "clipboard_score": F.least(F.lit(1.0), F.coalesce("paste_count", F.lit(0)) / rules.paste_full),
            "idle_score": F.lit(rules.idle_floor),
            "answer_changes_score": F.lit(0.1),
            "typing_score": F.lit(0.1),
        }
    )


def signal_items(rules: ScoringRules = ScoringRules()) -> Column:
    """Signals in reporting order as (pos, name, score, components)."""
    none = F.create_map().cast("map<string,double>")
    component = {
        "timing": ("avg_time", F.col("avg_time")),
        "tab": ("tab_hidden_count", F.col("tab_hidden_count")),
        "clipboard": ("paste_count", F.col("paste_count")),
    }
    items = []
    for pos, name in enumerate(rules.weights):
        parts = none
        if name in component:
            key, value = component[name]
            parts = F.create_map(F.lit(key), value.cast("double"))
        items.append(
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(name).alias("name"),
                F.col(f"{name}_score").alias("score"),
                parts.alias("components"),
            )
        )
    return F.array(*items)


def top_signals(k: int, rules: ScoringRules = ScoringRules()) -> Column:
    """The k highest signals as (rank_key, pos, name, score); ties stay in reporting order."""
    items = [
        F.struct(
            (-F.col(f"{n}_score")).alias("rank_key"),
            F.lit(pos).alias("pos"),
            F.lit(n).alias("name"),
            F.col(f"{n}_score").alias("score"),
        )
        for pos, n in enumerate(rules.weights)
    ]
    return F.slice(F.array_sort(F.array(*items)), 1, k)


def combine_signals(signals: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """Weighted mean, bonus for several supporting signals, caps for too few elevated ones."""
    names = list(rules.weights)
    total = sum(rules.weights.values())
    weighted = reduce(lambda a, b: a + b, [F.lit(rules.weights[n]) * F.col(f"{n}_score") for n in names])
    top = F.sort_array(F.array(*[F.col(f"{n}_score") for n in names]), asc=False)
    bonus = F.when(
        F.col("support_count") >= 2,
        rules.bonus_weight * ((F.element_at("_top", 1) + F.element_at("_top", 2)) / 2.0),
    ).otherwise(0.0)
    base = F.when(F.col("support_count") >= 2, F.least(F.lit(1.0), F.col("_mean") + F.col("bonus"))).otherwise(
        F.col("_mean")
    )
    capped = F.when(
        F.col("elevated_count") == 0, F.least("base_score", F.lit(min(rules.none_cap, rules.weak_cap)))
    ).when(F.col("elevated_count") < rules.require_elevated, F.least("base_score", F.lit(rules.weak_cap)))
    capped = capped.otherwise(F.col("base_score"))
    combined = F.when(
        F.col("strong_count") >= rules.require_elevated + 1,
        F.least(F.lit(1.0), capped + rules.strong_bonus),
    ).otherwise(capped)
    return (
        signals.withColumns(
            {
                "elevated_count": _count_at_least(names, rules.elevated),
                "strong_count": _count_at_least(names, rules.strong),
                "support_count": _count_at_least(names, rules.support),
                "_top": top,
                "_mean": weighted / total if total > 0 else F.lit(0.0),
            }
        )
        .withColumn("bonus", bonus)
        .withColumn("base_score", clamp01(base))
        .withColumn("combined_score", clamp01(combined))
        .drop("_top", "_mean")
    )


def assign_risk(score: Column, rules: ScoringRules = ScoringRules()) -> Column:
    elevated, strong, support = F.col("elevated_count"), F.col("strong_count"), F.col("support_count")
    return (
        F.when((score >= rules.high_score) & ((elevated >= 2) | (strong >= 1) | (support >= 4)), "HIGH")
        .when((score >= rules.medium_score) & ((support >= 1) | (elevated >= 1)), "MEDIUM")
        .otherwise("LOW")
    )


def promote_by_pattern(rows: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """LOW becomes MEDIUM when a pattern is strong enough."""
    lifted = (F.col("rule_risk") == "LOW") & (F.col("pattern_strength") >= rules.promote_strength)
    return rows.withColumn("promoted_by_pattern", F.coalesce(lifted, F.lit(False))).withColumn(
        "rule_risk", F.when(F.col("promoted_by_pattern"), "MEDIUM").otherwise(F.col("rule_risk"))
    )


def hybrid_decision(rows: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """Rules first; a confident prediction may lift the risk by one step."""
    rule, ml, conf = F.col("rule_risk"), F.col("ml_risk"), F.col("ml_confidence")
    evidence = (F.col("elevated_count") >= 1) | (F.col("strong_count") >= 1) | (F.col("pattern_count") > 0)
    to_medium = (rule == "LOW") & (ml == "MEDIUM") & (conf >= rules.ml_medium_confidence)
    to_high = (rule == "MEDIUM") & (ml == "HIGH") & (conf >= rules.ml_high_confidence) & evidence
    return rows.withColumns(
        {
            "risk": F.when(to_medium, "MEDIUM").when(to_high, "HIGH").otherwise(rule),
            "promoted_by_pattern": F.col("promoted_by_pattern") | to_medium | to_high,
        }
    )


def rule_confidence(rules: ScoringRules = ScoringRules()) -> Column:
    """Evidence strength plus amount of data plus distance from the thresholds."""
    one = F.lit(1.0)
    questions = F.least(one, F.col("questions_seen") / max(1, rules.full_questions))
    duration = F.least(one, F.col("attempt_duration_s") / max(1.0, rules.full_duration_s))
    data = 0.55 * questions + 0.45 * duration
    evidence = F.least(one, 0.30 * F.col("elevated_count") + 0.20 * F.col("strong_count"))
    margin = F.least(
        F.abs(F.col("combined_score") - rules.medium_score), F.abs(F.col("combined_score") - rules.high_score)
    )
    score = 0.75 * (0.60 * data + 0.40 * evidence) + 0.25 * F.least(one, margin / 0.30)
    score = score - rules.seq_gap_penalty * F.col("client_seq_gaps")
    score = score - F.when(F.col("has_submit_event"), 0.0).otherwise(rules.no_submit_penalty)
    return clamp01(score)


def evidence_confidence(rules: ScoringRules = ScoringRules()) -> Column:
    """Counts of notable signals, mean of the top three, strongest pattern."""
    names = list(rules.weights)
    counted = F.least(
        F.lit(1.0),
        (0.20 * F.col("support_count") + 0.35 * F.col("elevated_count") + 0.45 * F.col("strong_count")) / 2.0,
    )
    top = F.sort_array(F.array(*[F.col(f"{n}_score") for n in names]), asc=False)
    strength = (F.element_at(top, 1) + F.element_at(top, 2) + F.element_at(top, 3)) / 3
    pattern = F.coalesce(F.col("pattern_strength"), F.lit(0.0))
    return clamp01(rules.w_count * counted + rules.w_strength * strength + rules.w_patterns * pattern)


def blend_confidence(evidence: Column, ml: Column, rules: ScoringRules = ScoringRules()) -> Column:
    mixed = clamp01((1 - rules.ml_share) * evidence + rules.ml_share * ml)
    return F.when(ml > 0, mixed).otherwise(evidence)


def is_low_data(rules: ScoringRules = ScoringRules()) -> Column:
    quiet = reduce(lambda a, b: a & b, [F.col(f"{n}_score") <= 0.2 for n in rules.weights])
    return (F.col("questions_seen") == 0) & quiet & (F.col("pattern_count") == 0)
