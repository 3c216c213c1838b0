"""Classifier evaluation from label, prediction and score columns.

``by`` names grouping columns (a model name, a fold), so several models are
evaluated in one pass. Rank metrics work on one row per distinct score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.functions.expr import banded, safe_divide, texts
from creditspark.functions.ordering import TASK_ROWS, double_array, running_totals

EPS = 2.220446049250313e-16

# Acceptance thresholds and targets per metric.
MINIMUM = {"roc_auc": 0.75, "precision": 0.70, "recall": 0.65, "f1_score": 0.67, "accuracy": 0.75}
GOAL = {"roc_auc": 0.85, "precision": 0.80, "recall": 0.75, "f1_score": 0.77, "accuracy": 0.82}


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (label, prediction) with the row percentage."""
    c = df.groupBy(*by, F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    return c.withColumn("row_pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(*by, "label")))


def _cells(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on an empty denominator) and Matthews correlation."""
    return _with_rates(df.groupBy(*by).agg(*_cells(label, prediction)))


def _with_rates(cells: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "accuracy": safe_divide(tp + tn, tp + tn + fp + fn), "precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn),
        "f1_score": safe_divide(2 * tp, 2 * tp + fp + fn),
        "matthews_corrcoef": safe_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))})


def class_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class and their macro and weighted averages."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    pairs = df.groupBy(*by, y.alias("y"), p.alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(*by, "n", (F.col("y") == F.col("p")).alias("hit"), F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.lit("y").alias("side")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side")))).alias("s"))
    c = sides.groupBy(*by, "s.class").agg(
        F.sum(F.when(F.col("hit") & (F.col("s.side") == "y"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == "y", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"))
    per = c.select(*by, F.col("class").cast("string").alias("class"), safe_divide("tp", "predicted").alias("precision"),
                   safe_divide("tp", "support").alias("recall"),
                   safe_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"), "support")
    names = ["precision", "recall", "f1_score"]
    macro = per.groupBy(*by).agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = per.groupBy(*by).agg(*[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names],
                                    F.sum("support").alias("support"))
    cols = [*by, "class", *names, "support"]
    return (per.select(cols).unionByName(macro.withColumn("class", F.lit("macro avg")).select(cols))
            .unionByName(weighted.withColumn("class", F.lit("weighted avg")).select(cols)))


def weighted_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return class_report(df, label, prediction, by).where(F.col("class") == "weighted avg").drop("class")


def score_points(df: DataFrame, label: str, score: str, by: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per distinct score with running true and false positives from the top."""
    pts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")).where("score is not null")
    run = running_totals(pts, "score", ["pos", "neg"], by, descending=True, task_rows=task_rows, bound=df)
    return run.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def with_totals(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the class totals P and N: the last running counts of each group."""
    totals = points.groupBy(*by).agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    if by:
        return points.join(totals, list(by))
    one = totals.select(F.struct("P", "N")).scalar()
    return points.withColumns({"P": one["P"], "N": one["N"]})


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half."""
    pts = score_points(df, label, score, by, task_rows)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return pts.groupBy(*by).agg(F.try_divide(area, F.max("tp").cast("double") * F.max("fp")).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; ``bins`` rounds scores down to a grid first."""
    pts = with_totals(score_points(_gridded(df, score, bins), label, score, by), by)
    return pts.select(*by, F.col("score").alias("threshold"), safe_divide("fp", "N").alias("fpr"), safe_divide("tp", "P").alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    pts = with_totals(score_points(_gridded(df, score, bins), label, score, by), by)
    return pts.select(*by, F.col("score").alias("threshold"), safe_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                      safe_divide("tp", "P").alias("recall"))


def _gridded(df: DataFrame, score: str, bins: int | None) -> DataFrame:
    return df if bins is None else df.withColumn(score, F.floor(F.col(score) * bins) / bins)


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the recall step at each distinct score."""
    pts = score_points(df, label, score, by)
    return pts.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("tp")).alias("average_precision"))


def log_loss(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(score)))
    return df.groupBy(*by).agg(F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def threshold_sweep(df: DataFrame, label: str, score: str, points: int = 100) -> DataFrame:
    """Precision, recall and F1 at evenly spaced thresholds from one pass over the rows.

    0 where only one class is predicted.
    """
    cuts = [i * (1.0 / (points - 1)) for i in range(points - 1)] + [1.0]
    p, arr = F.col(score), double_array(cuts)
    k = F.least(F.greatest(F.floor(p * (points - 1)).cast("int"), F.lit(0)), F.lit(points - 1))
    k = F.when(F.get(arr, k + 1) <= p, k + 1).when(F.get(arr, k) > p, k - 1).otherwise(k)  # exact at the cut values
    counts = df.where(p.isNotNull()).select(k.alias("k"), F.col(label).alias("y")).groupBy("k").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    grid = df.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("k"))
    full = grid.join(counts, "k", "left").fillna(0)
    down = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)  # points + 1 rows
    every = W.partitionBy(F.lit(1))
    t = full.select("k", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                    F.sum("pos").over(every).alias("P"), F.sum(F.col("pos") + F.col("neg")).over(every).alias("n"))
    mixed = (F.col("tp") + F.col("fp") > 0) & (F.col("tp") + F.col("fp") < F.col("n"))

    def m(x):
        return F.when(mixed, x).otherwise(0.0)

    return t.where("k >= 0").select(
        F.col("k").alias("step"), F.get(arr, F.col("k")).alias("threshold"), m(safe_divide("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        m(safe_divide("tp", "P")).alias("recall"), m(safe_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P"))).alias("f1_score"))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and positive share per uniform bin (lo, hi]; empty bins are absent."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    b = banded(score, edges, list(range(bins)), side="lower")
    return df.where(F.col(score).isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"), F.count("*").alias("n"))


def business_metrics(df: DataFrame, label: str, prediction: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    p = F.col(score)
    n = F.col("total_customers")
    c = df.groupBy(*by).agg(
        F.count("*").alias("total_customers"), *_cells(label, prediction), F.count_if(p < 0.3).alias("low_risk_count"),
        F.count_if((p >= 0.3) & (p < 0.7)).alias("medium_risk_count"), F.count_if(p >= 0.7).alias("high_risk_count"))
    return c.withColumns({
        "actual_defaults": F.col("tp") + F.col("fn"), "predicted_defaults": F.col("tp") + F.col("fp"),
        "actual_default_rate": F.try_divide(F.col("tp") + F.col("fn"), n), "predicted_default_rate": F.try_divide(F.col("tp") + F.col("fp"), n),
        **{f"{lv}_risk_pct": F.try_divide(F.col(f"{lv}_risk_count") * 100.0, n) for lv in ("low", "medium", "high")}}).withColumnsRenamed(
        {"tp": "correctly_identified_defaults", "fn": "missed_defaults", "fp": "false_alarms", "tn": "true_negatives"})


def compare_models(long: DataFrame, label: str, score: str, model: str = "model", threshold: float = 0.5) -> DataFrame:
    """All metrics per model from a long (model, label, score) table, best AUC first.

    The rows are scored once: every metric follows from the class counts per distinct
    score. Rows without a score or a label count nowhere.
    """
    pos, neg, tp, fp, s = (F.col(c) for c in ("pos", "neg", "tp", "fp", "score"))
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), s))
    high = s >= threshold
    cells = {"tp": F.when(high, pos), "fp": F.when(high, neg), "fn": F.when(~high, pos), "tn": F.when(~high, neg)}
    points = score_points(long.where(F.col(label).isNotNull()), label, score, [model])
    out = points.groupBy(model).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in cells.items()],
        F.try_divide(F.sum(neg * (tp - pos / 2)), F.max("tp").cast("double") * F.max("fp")).alias("roc_auc"),
        F.try_divide(F.sum(pos * tp / (tp + fp)), F.max("tp")).alias("average_precision"),
        (-F.sum(pos * F.ln(p) + neg * F.ln(1 - p)) / F.sum(pos + neg)).alias("log_loss"))
    return _with_rates(out).orderBy(F.desc("roc_auc"), model)


def performance_level(auc: Column | str) -> Column:
    c = F.col(auc) if isinstance(auc, str) else auc
    return F.when(c >= 0.85, "Excellent").when(c >= 0.75, "Good").when(c >= 0.65, "Fair").otherwise("Poor")


def model_report(metrics: DataFrame, min_auc: float = 0.75) -> DataFrame:
    """Performance level and advice texts per row of metrics."""
    auc, pr, rc = F.col("roc_auc"), F.col("precision"), F.col("recall")
    advice = texts(
        (auc < min_auc, F.concat(F.lit("ROC-AUC ("), F.format_number(auc, 3), F.lit(f") below target ({min_auc}). Consider feature engineering."))),
        (pr < 0.7, F.concat(F.lit("Low precision ("), F.format_number(pr, 3), F.lit("). Consider adjusting threshold or improving features."))),
        (rc < 0.65, F.concat(F.lit("Low recall ("), F.format_number(rc, 3), F.lit("). Consider class balancing or threshold adjustment."))),
        (F.abs(pr - rc) > 0.2, "Significant precision-recall imbalance. Review threshold optimization."),
        default="Model performance meets criteria. Ready for deployment.")
    return metrics.withColumn("performance_level", performance_level("roc_auc")).withColumn("recommendations", advice)


def threshold_gate(metrics: DataFrame, keys: Sequence[str], minimum: Mapping[str, float] = MINIMUM, goal: Mapping[str, float] = GOAL,
                   baseline: Mapping[str, float] | None = None, degradation: float = 0.05) -> DataFrame:
    """pass / target status per metric and, against a baseline, a degradation alert."""
    names = [m for m in minimum if m in metrics.columns]
    cells = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(minimum[m]).alias("minimum"), F.lit(goal[m]).alias("goal"),
        F.lit((baseline or {}).get(m)).cast("double").alias("baseline")) for m in names])
    g = metrics.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return g.withColumns({
        "status": F.when(F.col("value") >= F.col("goal"), "target").when(F.col("value") >= F.col("minimum"), "acceptable").otherwise("below minimum"),
        "degraded": F.coalesce(F.col("baseline") - F.col("value") > degradation, F.lit(False))})
