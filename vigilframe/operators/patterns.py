"""Temporal and threshold patterns.

Candidates were found row by row in ``mark`` and folded into the feature row (``has_sequence``,
``quick_leaves``, ``best_quick_us``, ``second_quick_us``); what is left are gates and strengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HotKeys, PatternRules, ScoringRules
from vigilframe.operators.features import SECOND, aggregate, mark, sequence_evidence
from vigilframe.operators.scoring import detect_signals
from vigilframe.operators.timeline import Timeline, on_timelines

SEQUENCE = "idle_tab_paste_fast"
HIGH_TAB = "high_tab_low_time"
MEDIUM_TAB = "medium_tab_low_time_no_paste"
QUICK_LEAVE = "medium_idle_fast_no_paste"


def _ratio(rows: DataFrame) -> Column:
    return F.col("tab_hidden_ratio") if "tab_hidden_ratio" in rows.columns else F.lit(0.0)


def quick_leave_strength(question_us: Column, rules: PatternRules) -> Column:
    idle = F.least(F.lit(1.0), F.col("idle_spike_count") / 2.0)
    quick = F.greatest(F.lit(0.0), 1.0 - (question_us / SECOND) / max(1e-6, rules.fast_answer_s))
    return F.least(F.lit(0.85), 0.55 + 0.15 * idle + 0.15 * quick + 0.05 * F.col("timing_score"))


def gates(rows: DataFrame, rules: PatternRules) -> dict[str, Column]:
    ratio, tab = _ratio(rows), F.col("tab_hidden_count")
    no_paste = F.col("paste_count") == 0
    enough = F.col("questions_seen") >= rules.medium_min_questions
    mean = F.col("time_per_question_mean_s")
    return {
        SEQUENCE: (F.col("paste_count") >= rules.require_paste)
        & (F.col("idle_spike_count") >= 1)
        & (tab >= rules.require_hidden),
        HIGH_TAB: (F.col("tab_score") >= 0.70) & (F.col("timing_score") >= 0.70),
        MEDIUM_TAB: no_paste
        & enough
        & tab.between(rules.medium_tab_min, rules.medium_tab_max)
        & (ratio >= rules.medium_min_ratio)
        & (mean > 0)
        & (mean <= rules.medium_low_avg_s),
        QUICK_LEAVE: no_paste
        & (F.col("idle_spike_count") >= 1)
        & enough
        & ((tab >= rules.idle_fast_min_hidden) | (ratio >= rules.idle_fast_min_ratio)),
    }


def strengths(rows: DataFrame, rules: PatternRules) -> dict[str, Column]:
    one, tab = F.lit(1.0), F.col("tab_hidden_count")
    centre = (rules.medium_tab_min + rules.medium_tab_max) / 2.0
    band = 1.0 - F.least(one, F.abs(tab - centre) / max(1.0, centre))
    pace = F.least(
        one, (rules.medium_low_avg_s - F.col("time_per_question_mean_s")) / max(1.0, rules.medium_low_avg_s)
    )
    away = F.least(one, _ratio(rows) / max(1e-6, rules.medium_min_ratio))
    return {
        SEQUENCE: F.least(
            one,
            0.30
            + 0.25 * F.col("clipboard_score")
            + 0.20 * F.col("timing_score")
            + 0.15 * F.col("tab_score")
            + 0.10 * F.col("idle_score"),
        ),
        HIGH_TAB: F.least(one, 0.40 + 0.35 * F.col("tab_score") + 0.25 * F.col("timing_score")),
        MEDIUM_TAB: F.least(F.lit(0.85), 0.40 + 0.20 * band + 0.25 * pace + 0.15 * away),
        QUICK_LEAVE: quick_leave_strength(F.col("best_quick_us"), rules),
    }


def summarise_patterns(rows: DataFrame, rules: PatternRules = PatternRules()) -> DataFrame:
    """Count, highest strength and the two strongest patterns of each row."""
    gate, power = gates(rows, rules), strengths(rows, rules)
    has_sequence = gate[SEQUENCE] & F.col("has_sequence")
    quick = F.when(gate[QUICK_LEAVE], F.col("quick_leaves")).otherwise(0)

    def item(pos: int, when: Column, name: str, strength: Column) -> Column:
        return F.when(
            when,
            F.struct((-strength).alias("rank_key"), F.lit(pos).alias("pos"), F.lit(name).alias("pattern_type")),
        )

    found = F.array_sort(
        F.array_compact(
            F.array(
                item(0, has_sequence, SEQUENCE, power[SEQUENCE]),
                item(1, gate[HIGH_TAB], HIGH_TAB, power[HIGH_TAB]),
                item(2, gate[MEDIUM_TAB], MEDIUM_TAB, power[MEDIUM_TAB]),
                item(3, F.col("_quick") >= 1, QUICK_LEAVE, power[QUICK_LEAVE]),
                item(4, F.col("_quick") >= 2, QUICK_LEAVE, quick_leave_strength(F.col("second_quick_us"), rules)),
            )
        )
    )
    count = (
        has_sequence.cast("long") + gate[HIGH_TAB].cast("long") + gate[MEDIUM_TAB].cast("long") + F.col("_quick")
    )
    return (
        rows.withColumn("_quick", quick)
        .withColumns({"top_patterns": F.slice(found, 1, 2), "pattern_count": count})
        .withColumn(
            "pattern_strength",
            F.when(F.size("top_patterns") > 0, -F.element_at("top_patterns", 1)["rank_key"]).otherwise(0.0),
        )
        .drop("_quick")
    )


def _evidence(**values) -> list[Column]:
    names = {
        "idle_end_us": "long",
        "tab_hidden_us": "long",
        "paste_us": "long",
        "question_leave_us": "long",
        "question_id": "string",
        "question_time_s": "double",
    }
    return [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]


def _quick_match(rules: PatternRules, idle_end_us: Column, leave_us: Column, question: Column, quick_us: Column) -> list:
    return [
        F.lit(QUICK_LEAVE).alias("pattern_type"),
        quick_leave_strength(quick_us, rules).alias("strength"),
        *_evidence(
            idle_end_us=idle_end_us,
            question_leave_us=leave_us,
            question_id=question,
            question_time_s=quick_us / SECOND,
        ),
    ]


def _matches(t: Timeline, rules: PatternRules, scoring: ScoringRules, extended: bool) -> DataFrame:
    marked = mark(t, rules)
    extra = {"sequence": sequence_evidence()}
    if not t.sliced:
        # an attempt here has a bounded number of rows, so its quick leaves fit in one row
        quick = F.struct("last_idle_end_us", "t_us", "question_id", "quick_leave_us")
        extra["quick"] = F.collect_list(F.when(F.col("quick_leave_us").isNotNull(), quick))
    features = detect_signals(aggregate(marked, extended=extended, extra=extra), scoring)
    gate, power = gates(features, rules), strengths(features, rules)
    sequence = F.col("sequence")

    def match(name: str, when: Column, *evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("pattern_type"), power[name].alias("strength"), *evidence))

    # at most one match of these kinds per attempt
    single = F.array_compact(
        F.array(
            match(
                SEQUENCE,
                gate[SEQUENCE] & F.col("has_sequence"),
                *_evidence(
                    idle_end_us=sequence["last_idle_end_us"],
                    tab_hidden_us=sequence["last_hidden_us"],
                    paste_us=sequence["paste_us"],
                    question_leave_us=sequence["next_leave_us"],
                ),
            ),
            match(HIGH_TAB, gate[HIGH_TAB], *_evidence()),
            match(MEDIUM_TAB, gate[MEDIUM_TAB], *_evidence()),
        )
    )
    if not t.sliced:
        leaves = F.transform(
            F.when(gate[QUICK_LEAVE], F.col("quick")).otherwise(F.slice("quick", 1, 0)),
            lambda q: F.struct(
                *_quick_match(rules, q["last_idle_end_us"], q["t_us"], q["question_id"], q["quick_leave_us"])
            ),
        )
        return features.select("attempt_id", F.inline(F.concat(single, leaves)))
    # any number of quick leaves: they stay rows and only the gate is joined to them
    quick = Timeline(
        marked.rows.where("quick_leave_us IS NOT NULL").select(
            "attempt_id", "t_us", "last_idle_end_us", "question_id", "quick_leave_us"
        ),
        t.key,
        t.sliced,
        t.small,
    ).attach(features.where(gate[QUICK_LEAVE]).select("attempt_id", "idle_spike_count", "timing_score"))
    leave = [F.col(c) for c in ("last_idle_end_us", "t_us", "question_id", "quick_leave_us")]
    return features.select("attempt_id", F.inline(single)).unionByName(
        quick.rows.select("attempt_id", *_quick_match(rules, *leave))
    )


def detect_patterns(
    events: DataFrame,
    rules: PatternRules = PatternRules(),
    scoring: ScoringRules = ScoringRules(),
    extended: bool = False,
    limits: HotKeys = HotKeys(),
) -> DataFrame:
    """Long table of all matches with their evidence; quick leaves give one row each."""
    return on_timelines(events, lambda t: _matches(t, rules, scoring, extended), limits=limits)
