"""Texts and evidence shown to a reviewer, as columns over an attempt row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.scalar import filled, fixed

# Names and fallbacks shown in the review console.
UNKNOWN_NAME = "Unknown Candidate"
NO_EMAIL = "No email available"
DEFAULT_ASSESSMENT = "Python Coding Assessment"

# Event labels and tones.
EVENT_LABELS = {
    "exam_started": "Exam started",
    "exam_submitted": "Exam submitted",
    "clipboard": "Clipboard paste detected",
    "visibility_change": "Tab/window switch detected",
    "idle_state": "Idle activity gap detected",
}
EVENT_TONES = {
    "clipboard": "violation paste",
    "visibility_change": "violation tab",
    "idle_state": "violation idle",
    "question_answer": "violation answer",
    "exam_started": "violation exam",
    "exam_submitted": "violation exam",
}

# Evidence titles with their explanations.
EVIDENCE_TEXTS = {
    "Clipboard Activity": "Clipboard usage during an assessment may indicate copied or externally generated answers.",
    "Tab Switching": "The candidate left the assessment window. Repeated switching is suspicious when paired with other signals.",
    "Fast Answer Timing": "Very fast submissions can indicate external assistance, especially after tab or clipboard events.",
    "Idle + Burst Pattern": "Long inactivity followed by sudden answer activity can indicate external lookup behavior.",
    "Multi-Signal Pattern": "Combined behavioral evidence is stronger than any single violation alone.",
    "High Risk Score": "The total risk score crossed the high-risk review threshold.",
    "Moderate Risk Score": "The attempt contains enough behavioral evidence to justify manual review.",
    "Normal Behavior Pattern": "The available behavioral signals do not indicate strong assessment integrity risk.",
}


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def event_label(event_type: Column, question_id: Column) -> Column:
    label = F.when(event_type.isNull(), F.lit("Unknown event"))
    for name, text in EVENT_LABELS.items():
        label = label.when(event_type == name, F.lit(text))
    label = label.when(
        event_type == "question_view",
        F.concat(F.lit("Question "), F.coalesce(question_id, F.lit("")), F.lit(" viewed")),
    ).when(
        event_type == "question_answer",
        F.concat(F.lit("Answer submitted for "), filled(question_id, "question")),
    )
    return label.otherwise(F.replace(event_type, F.lit("_"), F.lit(" ")))


def event_tone(event_type: Column) -> Column:
    tone = F.when(F.lit(False), F.lit(""))
    for name, text in EVENT_TONES.items():
        tone = tone.when(event_type == name, F.lit(text))
    return tone.otherwise(F.lit("violation neutral"))


def build_reason(risk: Column, explanation: Column) -> Column:
    return (
        F.when(F.length(F.trim(explanation)) > 0, F.substring(explanation, 1, 500))
        .when(risk == "HIGH", F.lit("Risk escalated to HIGH based on strong behavioral evidence."))
        .when(risk == "MEDIUM", F.lit("Risk escalated to MEDIUM based on suspicious behavioral signals."))
        .otherwise(F.lit("Risk remains LOW. No major suspicious behavior detected."))
    )


def primary_issue() -> Column:
    paste, tab = _zero("paste_count"), _zero("tab_hidden_count")
    idle, mean = _zero("idle_spike_count"), _zero("time_per_question_mean_s")
    both = (paste > 0) & (tab > 0)
    return (
        F.when(both & (mean > 0) & (mean <= 20), F.lit("Clipboard + tab switch + fast answering pattern"))
        .when(both, F.lit("Clipboard and tab switching detected"))
        .when(paste > 0, F.lit("Clipboard activity detected"))
        .when(tab > 0, F.lit("Tab switching detected"))
        .when(idle > 0, F.lit("Idle activity gap detected"))
        .when((mean > 0) & (mean <= 12), F.lit("Fast answering pattern"))
        .otherwise(F.lit("No major violation detected"))
    )


def decision_text(risk: Column) -> Column:
    return (
        F.when(risk == "HIGH", F.lit("Urgent evaluator review recommended"))
        .when(risk == "MEDIUM", F.lit("Manual review recommended"))
        .otherwise(F.lit("No immediate review required"))
    )


def report_summary(risk: Column) -> Column:
    because = F.concat(F.lit(" The strongest reason is: "), primary_issue(), F.lit("."))
    return (
        F.when(risk == "HIGH", F.concat(F.lit("This attempt needs urgent review."), because))
        .when(risk == "MEDIUM", F.concat(F.lit("This attempt should be manually reviewed."), because))
        .otherwise(
            F.lit("This attempt currently appears normal. No strong suspicious behavioral pattern was detected.")
        )
    )


def exam_status(has_submit_feature: Column, latest_event_type: Column, any_submit: Column | None = None) -> Column:
    done = F.coalesce(has_submit_feature, F.lit(False)) | F.coalesce(
        latest_event_type == "exam_submitted", F.lit(False)
    )
    if any_submit is not None:
        done = done | F.coalesce(any_submit, F.lit(False))
    return F.when(done, F.lit("COMPLETED")).otherwise(F.lit("ONGOING"))


def latest_activity(latest_event_type: Column, latest_question_id: Column, explanation: Column) -> Column:
    return F.coalesce(
        F.when(F.length(latest_event_type) > 0, event_label(latest_event_type, latest_question_id)),
        F.nullif(explanation, F.lit("")),
        primary_issue(),
    )


def evidence_items() -> Column:
    """Array of (pos, title, severity, finding, explanation); never empty."""
    paste, tab = _zero("paste_count"), _zero("tab_hidden_count")
    idle, mean = _zero("idle_spike_count"), _zero("time_per_question_mean_s")
    score = _zero("combined_score")

    def counted(n: Column, what: str) -> Column:
        plural = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
        return F.concat(n.cast("long").cast("string"), F.lit(f" {what}"), plural, F.lit(" detected"))

    def band(n: Column, high: int, medium: int) -> Column:
        return F.when(n >= high, F.lit("HIGH")).when(n >= medium, F.lit("MEDIUM")).otherwise(F.lit("LOW"))

    def item(pos: int, when: Column, title: str, severity: Column, finding: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(title).alias("title"),
                severity.alias("severity"),
                finding.alias("finding"),
                F.lit(EVIDENCE_TEXTS[title]).alias("explanation"),
            ),
        )

    high, medium = F.lit("HIGH"), F.lit("MEDIUM")
    shown = F.concat(F.lit("Combined score: "), fixed(score, 2))
    items = F.array_compact(
        F.array(
            item(1, paste > 0, "Clipboard Activity", band(paste, 4, 2), counted(paste, "paste event")),
            item(2, tab > 0, "Tab Switching", band(tab, 5, 2), counted(tab, "tab switch event")),
            item(
                3,
                (mean > 0) & (mean <= 15),
                "Fast Answer Timing",
                F.when(mean <= 8, high).otherwise(medium),
                F.concat(F.lit("Average answer time: "), fixed(mean, 1), F.lit(" seconds")),
            ),
            item(
                4,
                idle > 0,
                "Idle + Burst Pattern",
                F.when(idle >= 3, high).otherwise(medium),
                counted(idle, "idle spike"),
            ),
            item(
                5,
                (paste > 0) & (tab > 0),
                "Multi-Signal Pattern",
                high,
                F.lit("Multiple suspicious signals occurred in one attempt"),
            ),
            item(6, score >= 0.6, "High Risk Score", high, shown),
            item(6, (score >= 0.25) & (score < 0.6), "Moderate Risk Score", medium, shown),
        )
    )
    normal = F.array(
        item(
            1,
            F.lit(True),
            "Normal Behavior Pattern",
            F.lit("LOW"),
            F.lit("No major suspicious behavior detected"),
        )
    )
    return F.when(F.size(items) > 0, items).otherwise(normal)
