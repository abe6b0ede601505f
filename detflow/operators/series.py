"""Chart series as tidy tables (C1-C8): (chart, model_type, age, series, value).

The reference draws these; here they are small projections of the results,
unpivoted with ``stack`` so one plan serves every series of a chart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0 END"


# chart -> [(series, SQL expression over the results row)]; shared with the oracle.
RESULT_CHARTS: dict[str, list[tuple[str, str]]] = {
    "ratios": [("a_to_the", "a_to_the_ratio"), ("the_to_a", "the_to_a_ratio"), ("total", "total_misclassified")],
    "counts": [("a_to_the", "CAST(a_to_the AS DOUBLE)"), ("the_to_a", "CAST(the_to_a AS DOUBLE)"),
               ("total", "CAST(a_to_the + the_to_a AS DOUBLE)")],
    "accuracy": [("overall", "overall_accuracy"), ("determiner", "determiner_accuracy")],
    "prediction_ratio": [("a", _ratio("a_predictions", "total_predictions")),
                         ("the", _ratio("the_predictions", "total_predictions")),
                         ("any", _ratio("pred_a_or_the", "total_predictions"))],
    "across_models": [("total_ratio", "total_misclassified"), ("determiner_accuracy", "determiner_accuracy"),
                      ("total_count", "CAST(pred_a_or_the AS DOUBLE)"),
                      ("any_ratio", _ratio("pred_a_or_the", "total_predictions"))],
}


def result_series(results: DataFrame, chart: str) -> DataFrame:
    spec = RESULT_CHARTS[chart]
    args = ", ".join(f"'{s}', CAST({e} AS DOUBLE)" for s, e in spec)
    return results.select(F.lit(chart).alias("chart"), "model_type", "age",
                          F.expr(f"stack({len(spec)}, {args}) AS (series, value)"))


def mean_errorbar(summary: DataFrame) -> DataFrame:
    """Mean and std of the generalisation ratio per model type."""
    return summary.select(F.lit("mean_errorbar").alias("chart"), "model_type", F.lit(None).cast("int").alias("age"),
                          F.expr("stack(2, 'mean', misclass_mean, 'std', misclass_std) AS (series, value)"))


def flexible_use_series(overall_results: DataFrame) -> DataFrame:
    """Child and model medians with lower/upper error (med-q1, q3-med) and
    the reference line at 2."""
    return overall_results.select(
        F.lit("flexible_use").alias("chart"), F.lit(None).cast("int").alias("model_type"),
        F.col("age_months").cast("int").alias("age"),
        F.expr("stack(7, 'child_median', child_median, 'child_err_lower', child_median - child_q1, "
               "'child_err_upper', child_q3 - child_median, 'model_median', model_median, "
               "'model_err_lower', model_median - model_q1, 'model_err_upper', model_q3 - model_median, "
               "'reference', CAST(2 AS DOUBLE)) AS (series, value)"))


def loss_series(curve: DataFrame) -> DataFrame:
    """Loss against the stitched global step, with the band it belongs to."""
    return curve.select(F.lit("loss").alias("chart"), "model_type", F.col("band_hi").cast("bigint").alias("band_hi"),
                        F.col("global_step").alias("step"), F.lit("loss").alias("series"), F.col("loss").alias("value"))
