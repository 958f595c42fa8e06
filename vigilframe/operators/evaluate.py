"""Evaluation of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import LABELS


def _cells(pairs: DataFrame, expected: str, predicted: str, labels: Sequence) -> DataFrame:
    """All counts in one row, one column per (expected, predicted)."""
    return pairs.agg(
        *[
            F.count_if((F.col(expected) == e) & (F.col(predicted) == p)).alias(f"c_{e}_{p}")
            for e in labels
            for p in labels
        ]
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0)))


def confusion_matrix(
    pairs: DataFrame, expected: str = "expected_label", predicted: str = "predicted_label", labels: Sequence = LABELS
) -> DataFrame:
    """One row per expected label, one column per predicted one; nothing missing."""
    row = lambda e: F.struct(F.lit(e).alias(expected), *[F.col(f"c_{e}_{p}").alias(str(p)) for p in labels])
    cells = _cells(pairs, expected, predicted, labels)
    return cells.select(F.explode(F.array(*[row(e) for e in labels])).alias("_r")).select("_r.*")


def confusion_with_totals(
    pairs: DataFrame, expected: str = "expected_label", predicted: str = "predicted_label", labels: Sequence = LABELS
) -> DataFrame:
    """The matrix with a total column and a TOTAL row."""
    cells = _cells(pairs, expected, predicted, labels)
    count = lambda es, ps: sum((F.col(f"c_{e}_{p}") for e in es for p in ps), F.lit(0).cast("long"))

    def row(name: str, es: Sequence) -> Column:
        return F.struct(
            F.lit(name).alias(expected),
            *[count(es, [p]).alias(str(p)) for p in labels],
            count(es, labels).alias("total"),
        )

    rows = [row(str(e), [e]) for e in labels] + [row("TOTAL", labels)]
    return cells.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def eval_metrics(
    pairs: DataFrame, expected: str = "expected_label", predicted: str = "predicted_label"
) -> DataFrame:
    """Accuracy, false positive rate, HIGH precision and recall, MEDIUM recall; empty groups give 0."""
    e, p = F.col(expected), F.col(predicted)
    n = lambda *tests: F.count_if(tests[0] if len(tests) == 1 else tests[0] & tests[1])
    high, medium, low = e == "HIGH", e == "MEDIUM", e == "LOW"
    return pairs.agg(
        F.count("*").alias("n_attempts"),
        _ratio(n(e == p), F.count("*")).alias("accuracy"),
        _ratio(n(low, p.isin("MEDIUM", "HIGH")), n(low)).alias("false_positive_rate"),
        _ratio(n(high, p == "HIGH"), n(p == "HIGH")).alias("high_precision"),
        _ratio(n(high, p == "HIGH"), n(high)).alias("high_recall"),
        _ratio(n(medium, p == "MEDIUM"), n(medium)).alias("medium_recall"),
    )


def label_counts(rows: DataFrame, column: str, labels: Sequence = LABELS) -> DataFrame:
    """Rows per label; labels that do not occur count 0."""
    counts = rows.agg(*[F.count_if(F.col(column) == label).alias(str(label)) for label in labels])
    item = lambda label: F.struct(F.lit(label).alias("label"), F.col(str(label)).alias("n"))
    return counts.select(F.explode(F.array(*[item(label) for label in labels])).alias("_r")).select("_r.*")


def classification_report(
    pairs: DataFrame, expected: str = "expected_label", predicted: str = "predicted_label", labels: Sequence = LABELS
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cells = _cells(pairs, expected, predicted, labels)
    cell = lambda e, p: F.col(f"c_{e}_{p}")
    total = sum((cell(e, p) for e in labels for p in labels), F.lit(0).cast("long"))
    values = {}
    for label in labels:
        hit = cell(label, label)
        support = sum((cell(label, p) for p in labels), F.lit(0).cast("long"))
        precision = _ratio(hit, sum((cell(e, label) for e in labels), F.lit(0).cast("long")))
        recall = _ratio(hit, support)
        values[label] = (precision, recall, _ratio(2 * precision * recall, precision + recall), support)

    def row(name: str, precision, recall, f1, support) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.alias("support"),
        )

    none = F.lit(None).cast("double")
    accuracy = _ratio(sum((cell(c, c) for c in labels), F.lit(0).cast("long")), total)
    # averages run over the classes that occur, as a label or as a prediction
    occurs = {c: F.when(values[c][3] + sum((cell(e, c) for e in labels), F.lit(0)) > 0, 1).otherwise(0) for c in labels}
    classes = sum(occurs.values(), F.lit(0))
    macro = [_ratio(sum((values[c][i] * occurs[c] for c in labels), F.lit(0.0)), classes) for i in range(3)]
    weighted = [_ratio(sum((values[c][i] * values[c][3] for c in labels), F.lit(0.0)), total) for i in range(3)]
    rows = [row(str(c), *values[c]) for c in labels]
    rows += [
        row("accuracy", none, none, accuracy, total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    ]
    return cells.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def binary_metrics(pairs: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy, precision and recall of the positive class 1, and the 2x2 matrix."""
    a, p = F.col(actual), F.col(predicted)
    n = lambda x, y: F.count_if((a == x) & (p == y))
    return pairs.agg(
        _ratio(n(0, 0) + n(1, 1), F.count("*")).alias("accuracy"),
        _ratio(n(1, 1), n(0, 1) + n(1, 1)).alias("precision"),
        _ratio(n(1, 1), n(1, 0) + n(1, 1)).alias("recall"),
        n(0, 0).alias("true_low_pred_low"),
        n(0, 1).alias("true_low_pred_medium"),
        n(1, 0).alias("true_medium_pred_low"),
        n(1, 1).alias("true_medium_pred_medium"),
    )


def per_attempt_eval(pairs: DataFrame) -> DataFrame:
    scenario = F.col("edge_case_scenario") if "edge_case_scenario" in pairs.columns else F.lit(None).cast("string")
    return pairs.select(
        "attempt_id",
        "expected_label",
        "predicted_label",
        F.col("confidence_score").alias("confidence"),
        "combined_score",
        F.col("explanation_text").alias("explanation"),
        F.coalesce("is_edge_case", F.lit(False)).alias("is_edge_case"),
        scenario.alias("edge_case_scenario"),
    )


def label_profile_distribution(labelled: DataFrame) -> DataFrame:
    """Attempts per label and per profile, and the LOW edge cases, as (kind, value, n)."""
    counted = labelled.groupingSets(
        [[F.col("expected_label")], [F.col("profile")]], F.col("expected_label"), F.col("profile")
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    both = counted.select(
        F.when(F.col("_g") == 1, "label").otherwise("profile").alias("kind"),
        F.when(F.col("_g") == 1, F.col("expected_label")).otherwise(F.coalesce("profile", F.lit(""))).alias("value"),
        "n",
    )
    edge = labelled.agg(F.count_if(F.col("is_edge_case") & (F.col("expected_label") == "LOW")).alias("n")).select(
        F.lit("edge").alias("kind"), F.lit("LOW").alias("value"), "n"
    )
    return both.unionByName(edge)


def class_distribution(rows: DataFrame, column: str = "risk") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)
