"""Default classifiers: training, tuning, cross-validation, batch scoring."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.expr import risk_band, risk_color
from creditspark.functions.ordering import hash_rank
from creditspark.functions.search import propose
from creditspark.operators import evaluation as V
from creditspark.operators.columns import select_features
from creditspark.operators.rows import best_by
from creditspark.operators.text import factor_lists
from creditspark.sources.io import materialize

FEATURES = "features"


def assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES, handleInvalid="error")


def features_vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The table with nulls of the model columns as 0 and a feature vector."""
    keep = [c for c in df.columns if c not in cols]
    return assembler(cols).transform(select_features(df, cols, keep))


def forest(label: str = "target", trees: int = 100, depth: int = 10, seed: int = 42, min_leaf: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol=FEATURES, numTrees=trees, maxDepth=depth, seed=seed,
                                  minInstancesPerNode=min_leaf, cacheNodeIds=depth > 10)


def logistic(label: str = "target", iterations: int = 1000, reg: float = 0.0, l1: float = 0.0) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=FEATURES, maxIter=iterations, regParam=reg, elasticNetParam=l1, standardization=True)


def boosted(label: str = "target", rounds: int = 100, depth: int = 6, rate: float = 0.1, rows: float = 1.0, columns: float | None = None,
            seed: int = 42, validation: str | None = None, min_leaf: int = 1) -> GBTClassifier:
    est = GBTClassifier(labelCol=label, featuresCol=FEATURES, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=rows, seed=seed,
                        featureSubsetStrategy="all" if columns is None else str(columns), minInstancesPerNode=min_leaf,
                        validationTol=0.001)
    # with a validation column, boosting stops when the loss on its rows no longer improves
    return est.setValidationIndicatorCol(validation) if validation else est


# Model families by name; the three boosting libraries map to presets of one boosted-tree estimator.
FAMILIES = {
    "random_forest": lambda label, seed, **p: forest(label, seed=seed, **p),
    "logistic_regression": lambda label, seed, **p: logistic(label, **p),
    "gbt": lambda label, seed, **p: boosted(label, seed=seed, **p),
    "xgboost": lambda label, seed, **p: boosted(label, seed=seed, **{"rows": 0.8, "columns": 0.8, **p}),
    "lightgbm": lambda label, seed, **p: boosted(label, seed=seed, **{"rows": 0.8, "columns": 0.8, **p}),
    "catboost": lambda label, seed, **p: boosted(label, seed=seed, **p),
}

# Search spaces per family: (low, high, kind).
SPACES = {
    "random_forest": {"trees": (50, 300, "int"), "depth": (3, 20, "int"), "min_leaf": (1, 10, "int")},
    "logistic_regression": {"reg": (0.01, 100.0, "log"), "l1": (0, 1, "int")},
    "gbt": {"rounds": (50, 300, "int"), "depth": (3, 10, "int"), "rate": (0.01, 0.3, "real"), "rows": (0.6, 1.0, "real")},
}


def estimator(family: str, label: str, seed: int = 42, **params) -> Estimator:
    if family not in FAMILIES:
        raise ValueError(f"unknown family: {family}")
    return FAMILIES[family](label, seed, **params)


def train_model(df: DataFrame, cols: Sequence[str], label: str, family: str, seed: int = 42, validation: str | None = None, **params) -> PipelineModel:
    """Fit one family. ``validation`` names a boolean column that marks the rows for early stopping of boosted trees."""
    if validation and family not in ("random_forest", "logistic_regression"):
        params["validation"] = validation
    data = select_features(df, cols, [c for c in (label, validation) if c])
    return Pipeline(stages=[assembler(cols), estimator(family, label, seed, **params)]).fit(data)


def train_all(df: DataFrame, cols: Sequence[str], label: str, families: Mapping[str, Mapping], seed: int = 42) -> dict[str, PipelineModel]:
    """Fit several families on the same cached table."""
    data = select_features(df, cols, [label]).persist()
    try:
        return {f: train_model(data, cols, label, f, seed, **dict(p)) for f, p in families.items()}
    finally:
        data.unpersist()


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def add_scores(df: DataFrame, models: Mapping[str, Transformer], cols: Sequence[str], prefix: str = "p_") -> DataFrame:
    """One probability column per model. All models read the same assembled vector, so nothing is joined or shuffled."""
    filled = {f"_x{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for i, c in enumerate(cols)}
    out = VectorAssembler(inputCols=list(filled), outputCol=FEATURES).transform(df.withColumns(filled)).drop(*filled)
    keep = list(out.columns)
    for name, model in models.items():
        last = model.stages[-1] if isinstance(model, PipelineModel) else model
        out = last.transform(out).withColumn(prefix + name, positive_probability())
        keep.append(prefix + name)
        out = out.select(*keep)
    return out.drop(FEATURES)


def batch_predict(df: DataFrame, models: Mapping[str, Transformer], cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Probability, class and risk category from one model or the mean of several.

    The class of an ensemble is the mean of the 0/1 votes against the threshold.
    """
    out = add_scores(df, models, cols)
    ps = [F.col(f"p_{m}") for m in models]
    mean = sum(ps[1:], ps[0]) / len(ps)
    votes = sum([F.when(p > 0.5, 1.0).otherwise(0.0) for p in ps], F.lit(0.0)) / len(ps)
    out = out.withColumns({"probability": mean, "prediction": F.when(votes >= threshold, 1).otherwise(0)})
    return out.withColumn("risk_category", risk_band("probability")).withColumn("risk_color", risk_color("risk_category"))


def compare(df: DataFrame, models: Mapping[str, Transformer], cols: Sequence[str], label: str) -> DataFrame:
    """Metrics of every model on one table, from one scoring pass."""
    scored = add_scores(df.select(label, *cols), models, cols)
    long = scored.select(label, *[F.col(f"p_{m}").alias(m) for m in models]).unpivot([label], list(models), "model", "score")
    return V.compare_models(long, label, "score")


def train_all_best(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, families: Mapping[str, Mapping],
                   metric: str = "roc_auc", seed: int = 42) -> tuple[DataFrame, str, dict[str, PipelineModel]]:
    """(metrics per family, name of the best, models)."""
    models = train_all(train, cols, label, families, seed)
    table = compare(test, models, cols, label)
    best = best_by(table, "model", metric).first()["model"]
    return table, best, models


def draw_params(family: str, trials: int, seed: int = 42) -> list[dict]:
    """Random parameter sets from the family's search space."""
    rng = random.Random(seed)
    space = SPACES.get(family, SPACES["gbt"])
    out = []
    for _ in range(trials):
        p = {}
        for k, (lo, hi, kind) in space.items():
            p[k] = rng.randint(lo, hi) if kind == "int" else lo * (hi / lo) ** rng.random() if kind == "log" else rng.uniform(lo, hi)
        out.append(p)
    return out


def tune(df: DataFrame, cols: Sequence[str], label: str, family: str, keys: Sequence[str], trials: int = 50, folds: int | None = None,
         params: Sequence[Mapping] | None = None, seed: int = 42, sampler: str = "parzen") -> tuple[DataFrame, dict]:
    """(trial table with mean AUC, best parameters) by a validation fifth or by k folds.

    Trials come one by one from the density ratio of good and other trials (``parzen``), at
    random (``random``), or from the list ``params``. The folded table is written once.
    """
    if sampler not in ("parzen", "random"):
        raise ValueError(f"unknown sampler: {sampler}")
    if params is None and sampler == "random":
        drawn = draw_params(family, trials, seed)
    space, n = SPACES.get(family, SPACES["gbt"]), df.count() if family == "logistic_regression" and params is None else 0
    k = folds or 5
    data = materialize(add_folds(select_features(df, cols, [label, *keys]), keys, label, k, seed), "folds")
    history: list[tuple[dict, float]] = []
    used: list[dict] = []
    for i in range(trials if params is None else len(params)):
        if params is not None:
            tried = dict(params[i])
        else:
            tried = drawn[i] if sampler == "random" else propose(space, history, seed)
        # the space holds the inverse penalty of the whole loss, Spark takes the penalty per row
        used.append({**tried, "reg": 1.0 / (tried["reg"] * n)} if n else tried)
        aucs = []
        for f in range(k if folds else 1):
            model = train_model(data.where(F.col("fold") != f), cols, label, family, seed, **used[-1])
            aucs.append(_auc(data.where(F.col("fold") == f), model, cols, label))
        history.append((tried, sum(aucs) / len(aucs)))
    if not history:
        raise ValueError("no trials")
    best = max(range(len(history)), key=lambda i: (history[i][1], -i))
    rows = [(i, str(p), auc) for i, (p, (_, auc)) in enumerate(zip(used, history))]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, mean_auc double"), used[best]


def _auc(df: DataFrame, model: Transformer, cols: Sequence[str], label: str) -> float:
    auc = V.roc_auc(add_scores(df, {"m": model}, cols), label, "p_m").first()["roc_auc"]
    if auc is None:
        raise ValueError("a fold holds one class only, its area under the curve is undefined; use fewer folds or stratify")
    return auc


def add_folds(df: DataFrame, keys: Sequence[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold number 0..k-1, the same for any partitioning."""
    return hash_rank(df, keys, [label], seed, rank="_fr").withColumn("fold", (F.col("_fr") % k).cast("int")).drop("_fr")


def cross_validate(df: DataFrame, cols: Sequence[str], label: str, family: str, keys: Sequence[str], k: int = 5, seed: int = 42,
                   train_scores: bool = False, **params) -> DataFrame:
    """Metrics per fold (and on the training part when asked), from one union of scored folds.

    The folded table is written once: every fold trains and scores from it.
    """
    data = materialize(add_folds(select_features(df, cols, [label, *keys]), keys, label, k, seed), "folds")
    parts = []
    for f in range(k):
        model = train_model(data.where(F.col("fold") != f), cols, label, family, seed, **params)
        sides = [("test", F.col("fold") == f)] + ([("train", F.col("fold") != f)] if train_scores else [])
        for side, cond in sides:
            parts.append(add_scores(data.where(cond), {"m": model}, cols).select(
                F.lit(f).alias("fold"), F.lit(side).alias("side"), label, F.col("p_m").alias("score")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    by = ["fold", "side"]
    m = V.binary_metrics(scored.withColumn("pred", (F.col("score") >= 0.5).cast("int")), label, "pred", by)
    return m.join(V.roc_auc(scored, label, "score", by), by)


def summarize_folds(per_fold: DataFrame, metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1_score", "roc_auc")) -> DataFrame:
    """Mean and population std over the folds."""
    return per_fold.unpivot(["fold", "side"], list(metrics), "metric", "value").groupBy("side", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("folds"))


def importances(model: Transformer, cols: Sequence[str]) -> list[tuple[str, float]]:
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "featureImportances"):
        v = last.featureImportances.toArray()
    else:
        v = abs(last.coefficients.toArray())
    return sorted(((c, float(x)) for c, x in zip(cols, v)), key=lambda p: (-p[1], p[0]))


def feature_importance(model: Transformer, cols: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted model, largest first."""
    return df.sparkSession.createDataFrame(importances(model, cols), "feature string, importance double")


def explain_prediction(df: DataFrame, models: Mapping[str, Transformer], cols: Sequence[str], top: int = 5) -> DataFrame:
    """Scores, factor texts and the most important features per row."""
    from creditspark.operators.scoring import decide

    first = next(iter(models.values()))
    names = [n for n, _ in importances(first, cols)[:top]]
    out = factor_lists(decide(batch_predict(df, models, cols), "probability"))
    return out.withColumn("key_features", F.array(*[F.lit(n) for n in names]))


def save_models(models: Mapping[str, PipelineModel], path: str, results: DataFrame | None = None) -> None:
    """Every model under its name, the training results as JSON next to them."""
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/{name}")
    if results is not None:
        results.write.mode("overwrite").json(f"{path}/results")


def load_model(path: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{name}")
