"""Explanations as columns: a list of summary sentences, a list of reasons and one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import ScoringRules
from vigilframe.functions.scalar import fixed, percent
from vigilframe.operators.scoring import top_signals

# Sentences of the explanation.
RISK_SENTENCES = {
    "HIGH": "Strong indicators of cheating behavior detected.",
    "MEDIUM": "Suspicious behavior detected; requires review.",
}
LOW_SENTENCE = "No significant suspicious behavior detected."
FEW_QUESTIONS = "Limited data available; confidence may be lower."
ODD_TIMING = "Answer timing pattern appears inconsistent with normal behavior."
NO_REASON = "No strong suspicious patterns detected."
NO_DATA = "Insufficient behavioral data for reliable analysis."
NO_DATA_REASON = "Too few interactions detected and no suspicious signals."


def _optional(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(0.0)


def explain(rows: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """Add ``summary`` and ``reasons``; needs risk, features, signals and ``top_patterns``."""
    sentence = F.lit(LOW_SENTENCE)
    for label, text in RISK_SENTENCES.items():
        sentence = F.when(F.col("risk") == label, F.lit(text)).otherwise(sentence)
    counts = F.concat(
        F.lit("Attempt had "),
        F.col("questions_seen").cast("string"),
        F.lit(" questions over ~"),
        fixed(F.col("attempt_duration_s") / 60.0, 1),
        F.lit(" minutes."),
    )
    patterns = F.transform(
        "top_patterns",
        lambda p: F.concat(
            F.lit("Detected pattern: "),
            p["pattern_type"],
            F.lit(" (strength="),
            fixed(-p["rank_key"], 2),
            F.lit(")."),
        ),
    )
    fast = _optional(rows, "fast_ratio")
    wording = F.create_map(
        F.lit("tab"),
        F.concat(
            F.lit("User spent "), percent(_optional(rows, "tab_hidden_ratio")), F.lit(" of time outside the test window.")
        ),
        F.lit("clipboard"),
        F.concat(F.col("paste_count").cast("string"), F.lit(" paste actions detected.")),
        F.lit("timing"),
        F.when(
            fast > 0, F.concat(F.lit("Unusually fast responses detected ("), percent(fast), F.lit(")."))
        ).otherwise(F.lit(ODD_TIMING)),
        F.lit("idle"),
        F.concat(F.lit("High idle time detected ("), percent(_optional(rows, "idle_ratio")), F.lit(").")),
    )
    notable = F.filter(top_signals(4, rules), lambda s: s["score"] >= 0.50)
    spoken = F.array_compact(F.transform(notable, lambda s: F.try_element_at(F.col("_wording"), s["name"])))
    few = F.when(F.col("questions_seen") <= 2, F.array(F.lit(FEW_QUESTIONS))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        rows.withColumn("_wording", wording)
        .withColumns(
            {
                "summary": F.concat(
                    F.array(F.concat(F.lit("Risk="), F.col("risk"), F.lit(".")), sentence, counts), patterns
                ),
                "reasons": F.concat(few, spoken),
            }
        )
        .withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(NO_REASON))))
        .drop("_wording")
    )


def explanation_text(rows: DataFrame) -> DataFrame:
    """Add the ML and hybrid sentences and join everything into ``explanation_text``."""
    ml = F.concat(F.lit("ML prediction="), F.col("ml_risk"), F.lit("."))
    conf = F.concat(F.lit("ML confidence="), fixed(F.col("ml_confidence"), 2), F.lit("."))
    added = F.when(F.col("ml_confidence") != 0, F.array(ml, conf)).otherwise(F.array(ml))
    hybrid = F.concat(
        F.lit("Hybrid decision used rule risk="),
        F.col("rule_risk"),
        F.lit(" and ML risk="),
        F.col("ml_risk"),
        F.lit("."),
    )
    return rows.withColumns(
        {"summary": F.concat("summary", added), "reasons": F.array_append("reasons", hybrid)}
    ).withColumn(
        "explanation_text",
        F.trim(F.concat(F.array_join("summary", " "), F.lit(" "), F.array_join("reasons", " "))),
    )
