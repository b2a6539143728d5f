"""Walk-forward training, scoring and explanation of the models with pyspark.ml.

Another boosting library than LightGBM: splits, schemas and formulas are as described, figures differ.  Boosting stops early by the last
VALIDATION of a fold's training rows, not by its test rows, so figures are of rows that no choice was made by.  The signal model has a boosted
ensemble for each class against the rest, whose probabilities are scaled to one.  Explanations are exact Shapley values and permutation.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Normalizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.operators import models, shapley
from tickforge.operators.ordering import BLOCK, numbered
from tickforge.sources.scratch import path_of, written
from tickforge.sources.tables import read_json, write_json

#: Columns that are no features: times, levels, labels.
EXCLUDED = frozenset("bar_time bar_seq open high low close price_volume future_close future_return magnitude_label direction_label sl_points tp_points trade_label long_result short_result long_bars_held short_bars_held long_mae short_mae long_mfe short_mfe is_rth atr_target has_trade_outcome quality_label max_single_buy max_single_sell row_no label".split())
#: The generations of models, and the share of rows before the first fold and the least rows of each.
FIRST, SECOND = ("direction", "magnitude"), ("signal", "volatility", "quality")
RULES = {
    "direction": {"ratio": 0.3}, "magnitude": {"ratio": 0.3}, "signal": {"ratio": 0.5, "least_train": 100, "least_test": 20},
    "volatility": {"ratio": 0.5, "least_train": 100, "least_test": 20}, "quality": {"ratio": 0.5, "least_train": 100, "least_test": 20},
}
REGRESSIONS = ("magnitude", "volatility")
#: Models that are trained only if there are more rows than this.
LEAST_ROWS = {"quality": 200}
#: The share of training rows, the last in time, that boosting is stopped by, and the gain of a round that it goes on for.
VALIDATION, GAIN = 0.15, 0.001
SIGNAL_CLASSES = 3


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns in order, but for those excluded and those that start with _."""
    return [c for c, t in df.dtypes if c not in EXCLUDED and not c.startswith("_") and t in ("int", "bigint", "double", "float")]


def learner(kind: str, seed: int = 42, trees: int = 20, depth: int = 4, name: str = ""):
    """magnitude and volatility: a number; else two classes.  Rows with _held stop the boosting."""
    own = {"maxIter": trees, "maxDepth": depth, "seed": seed, "validationIndicatorCol": "_held", "validationTol": GAIN, "predictionCol": f"prediction{name}"}
    if kind in REGRESSIONS:
        return GBTRegressor(**own)
    return GBTClassifier(**own).setRawPredictionCol(f"rawPrediction{name}").setProbabilityCol(f"probability{name}")


def fitted(kind: str, d: DataFrame, features: list[str], **learning) -> PipelineModel:
    """A model of rows with label and _held."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    d = assembler.transform(d).select("features", "label", "_held").cache()
    try:
        if kind != "signal":
            return PipelineModel([assembler, learner(kind, **learning).fit(d)])
        each = [learner(kind, name=f"_{k}", **learning).fit(d.withColumn("label", (F.col("label") == k).cast("double"))) for k in range(SIGNAL_CLASSES)]
    finally:
        d.unpersist()
    # Of each ensemble the probability that a row is of its class, scaled to the sum of one.
    every = VectorAssembler(inputCols=[f"probability_{k}" for k in range(SIGNAL_CLASSES)], outputCol="_every")
    own = VectorSlicer(inputCol="_every", outputCol="_own", indices=[2 * k + 1 for k in range(SIGNAL_CLASSES)])
    return PipelineModel([assembler, *each, every, own, Normalizer(p=1.0, inputCol="_own", outputCol="probability")])


def transformed(model: PipelineModel, d: DataFrame) -> DataFrame:
    """d with prediction, and with probability if the model has classes; the columns between go."""
    p = model.transform(d)
    if "prediction" not in p.columns:
        each = vector_to_array("probability")
        p = p.withColumn("prediction", (F.array_position(each, F.array_max(each)) - 1).cast("double"))
    return p.select(*d.columns, *(c for c in ("probability", "prediction") if c in p.columns))


def rounds(model: PipelineModel) -> list[int]:
    """The trees of each ensemble, after early stopping."""
    return [len(e.treeWeights) for e in shapley.ensembles(model)]


def labelled(df: DataFrame, kind: str) -> DataFrame:
    """The rows that a model is trained on, with its label."""
    if kind == "direction":
        return df.where("direction_label <> 0").withColumn("label", (F.col("direction_label") > 0).cast("double"))
    if kind == "magnitude":
        return df.where("magnitude_label > 0").withColumn("label", F.col("magnitude_label"))
    if kind == "volatility":
        return df.where("atr_target IS NOT NULL").withColumn("label", F.col("atr_target"))
    if kind == "quality":
        return df.where("is_rth AND has_trade_outcome = 1").withColumn("label", F.col("quality_label").cast("double"))
    return df.where("is_rth").withColumn("label", (F.col("trade_label") + 1).cast("double"))


def train(df: DataFrame, kind: str, features: list[str] | None = None, folds: int = 5, ratio: float | None = None, least_train: int | None = None, least_test: int | None = None, **learning) -> tuple[PipelineModel | None, list[dict]]:
    """The best fold's model and every fold's metrics (measured on rows that the fold's model hasn't seen).

    Rows are numbered in order of bar_seq, by blocks, to cut folds at exact shares; rows without a feature are left out.
    """
    features = features or feature_columns(df)
    rule = {"ratio": 0.5, "least_train": 0, "least_test": 0} | RULES[kind] | {k: v for k, v in (("ratio", ratio), ("least_train", least_train), ("least_test", least_test)) if v is not None}
    d = labelled(df.dropna(subset=features), kind).select("bar_seq", "label", *features)
    d = written(numbered(d, F.floor(F.col("bar_seq") / BLOCK), ["bar_seq"], "row_no"), f"train-{kind}")
    best, report, n = None, [], d.count()
    for fold, start, end in models.walk_forward(n, folds, **rule) if n > LEAST_ROWS.get(kind, 0) else []:
        model = fitted(kind, d.where(F.col("row_no") < start).withColumn("_held", F.col("row_no") >= int(start * (1 - VALIDATION))), features, **learning)
        test = transformed(model, d.where((F.col("row_no") >= start) & (F.col("row_no") < end)))
        m = (models.regression_metrics if kind in REGRESSIONS else models.classification_metrics)(test).first().asDict()
        if kind == "signal":
            m |= models.trade_metrics(test).first().asDict()
        score = -m["mae"] if kind in REGRESSIONS else m["f1"] if kind == "quality" else m["accuracy_trades"] if kind == "signal" else m["accuracy"]
        report.append({"fold": fold, "train": start, "test": end - start, "rounds": rounds(model), **m})
        if best is None or score > best[0]:
            best = (score, model)
    return (best[1] if best else None), report


def averages(report: list[dict]) -> dict[str, float]:
    """The mean of each figure over a model's folds."""
    names = [k for k in (report[0] if report else {}) if k not in ("fold", "train", "test", "rounds")]
    return {k: sum(r[k] or 0.0 for r in report) / len(report) for k in names}


def importance(model: PipelineModel, features: list[str], k: int = 20) -> list[tuple[str, float]]:
    """Features by the gain of their splits, the mean of the model's ensembles."""
    each = [e.featureImportances.toArray() for e in shapley.ensembles(model)]
    return sorted(zip(features, (sum(each) / len(each)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], which: list[str] | None = None, seed: int = 7) -> list[tuple[str, float]]:
    """The loss of accuracy when a feature (of all, or of those in `which`) is dealt anew among the rows: each takes that of the row before it in a random order.

    Rows are numbered along the order by blocks of it and joined with the numbers shifted by one, once for all features.
    """
    draw = F.xxhash64(F.lit(seed), "bar_seq")
    d = numbered(df.withColumn("_draw", draw), F.shiftright("_draw", 48), ["_draw", "bar_seq"], "_place")
    d = written(d.select("_place", "label", *features), "permutation")
    which = which or features
    before = d.select((F.col("_place") + 1).alias("_place"), *(F.col(f).alias(f"_b_{f}") for f in which))
    both = written(d.join(before, "_place", "left"), "permuted")
    right = lambda x: models.classification_metrics(transformed(model, x)).first()["accuracy"] or 0.0
    base = right(d)
    out = [(f, base - right(both.withColumn(f, F.coalesce(f"_b_{f}", f)))) for f in which]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def contributions(model: PipelineModel, rows: DataFrame, features: list[str], key: str = "bar_seq") -> DataFrame:
    """(key, feature, value, contribution): Shapley values of the last class (of the signal: long), or of the number that a regression gives."""
    last = len(shapley.ensembles(model)) - 1
    return shapley.contributions(model, rows, features, key).where(F.col("class") == last).drop("class")


def top_factors(found: DataFrame, key: str = "bar_seq", k: int = 5) -> DataFrame:
    """(key, rank, feature, value, contribution): each row's k largest contributions."""
    order = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "feature", "value", "contribution")


def class_factors(found: DataFrame, won: DataFrame, key: str = "bar_seq", k: int = 15, least: int = 10) -> DataFrame:
    """Features by the difference of their mean |contribution| between rows that won (key, won) and lost; empty unless both have `least` rows."""
    d = found.join(won, key)
    size = F.abs("contribution")
    win, lose = F.when(F.col("won"), size), F.when(~F.col("won"), size)
    g = d.groupBy("feature").agg(F.avg(win).alias("winner_mean"), F.avg(lose).alias("loser_mean"), F.count(win).alias("nw"), F.count(lose).alias("nl"))
    g = g.where((F.col("nw") >= least) & (F.col("nl") >= least)).withColumn("difference", F.col("winner_mean") - F.col("loser_mean"))
    return g.select("feature", "winner_mean", "loser_mean", "difference").orderBy(F.abs("difference").desc(), "feature").limit(k)


def global_factors(found: DataFrame, k: int = 15) -> DataFrame:
    """(rank, feature, importance, corr, effect) of (class, feature, value, contribution): by mean |contribution| over rows and classes, with the correlation of value and contribution in the last class."""
    last = F.col("class") == found.agg(F.max("class")).first()[0]
    x, y = F.when(last, F.col("value")), F.when(last, F.col("contribution"))
    size = found.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("corr"), F.count(x).alias("_n"))
    corr = F.when((F.col("_n") > 10) & ~F.isnan("corr"), F.col("corr"))
    order = [F.col("importance").desc(), F.col("feature")]
    top = size.withColumns({"corr": corr, "effect": F.when(corr.isNotNull(), models.effect_of(corr))}).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "feature", "importance", "corr", "effect")


def probabilities(model: PipelineModel, df: DataFrame, names: list[str]) -> DataFrame:
    """df with a column for each class's probability; every bar with features, also the newest."""
    p = transformed(model, df).withColumn("_p", vector_to_array("probability"))
    return p.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p", "probability", "prediction")


def predicted(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """df with a regression's number."""
    return transformed(model, df).withColumnRenamed("prediction", name)


def scored(kept: dict[str, PipelineModel], features: list[str], bars: DataFrame) -> DataFrame:
    """bars with prob_long, prob_short, quality (NULL without that model) and atr, as a backtest and live signals take them; rows without a feature have NULL scores."""
    d = bars.dropna(subset=features)
    d = probabilities(kept["signal"], d, ["prob_short", "_flat", "prob_long"]).drop("_flat")
    d = probabilities(kept["quality"], d, ["_bad", "quality"]).drop("_bad") if "quality" in kept else d.withColumn("quality", F.lit(None).cast("double"))
    d = predicted(kept["volatility"], d, "_atr") if "volatility" in kept else d.withColumn("_atr", F.lit(None).cast("double"))
    s = d.select("bar_seq", "prob_long", "prob_short", "quality", F.coalesce("_atr", "atr_14").alias("atr"))
    return bars.drop("prob_long", "prob_short", "quality", "atr").join(s, "bar_seq", "left")


def save(kept: dict[str, PipelineModel], path: str, features: list[str], reports: dict[str, list[dict]], **more) -> None:
    """The models and training_meta.json, in any file system that Spark writes to."""
    spark = SparkSession.getActiveSession()
    for kind, model in kept.items():
        model.write().overwrite().save(f"{path}/{kind}")
    meta = {"features": features, "models": sorted(kept), "folds": reports, "averages": {k: averages(r) for k, r in reports.items()}, **more}
    write_json(spark, json.loads(json.dumps(meta, default=str)), f"{path}/training_meta.json")


def load(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict]:
    """(models by kind, metadata) as saved; a model whose folder is missing is left out."""
    meta = read_json(spark, f"{path}/training_meta.json")
    there = lambda kind: (lambda fs_p: fs_p[0].exists(fs_p[1]))(path_of(spark, f"{path}/{kind}"))
    return {k: PipelineModel.load(f"{path}/{k}") for k in meta["models"] if there(k)}, meta
