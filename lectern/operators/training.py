"""Fitting, choosing and applying classifiers of text. The linear pipeline stands in where fine-tuning has no framework or weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_device() -> str:
    """cuda where a framework sees one, else cpu. Call it on the worker that computes."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def devices(spark: SparkSession, tasks: int = 8) -> list[str]:
    """What the workers see, asked on them."""
    return sorted({x.device for x in spark.range(0, tasks, 1, tasks).select(F.udf(pick_device, "string", useArrow=False)().alias("device")).distinct().collect()})


def linear_trainer(text_col: str = "text", label_col: str = "label", features: int = 1 << 16, regularisation: float = 0.0, rounds: int = 50) -> Pipeline:
    """Hashed TF-IDF and logistic regression, JVM-side throughout."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", gaps=False),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol=label_col, regParam=regularisation, maxIter=rounds),
        ]
    )


def fit(train: DataFrame, trainer: Pipeline | None = None) -> PipelineModel:
    return (trainer or linear_trainer()).fit(train)


def fine_tune(train: DataFrame, loop: Callable, processes: int = 1, use_gpu: bool | None = None, **arguments):
    """Runs a training loop of the caller's on the cluster's workers by Spark's torch distributor. Needs torch, which is not installed
    here: the call has not been tried."""
    from pyspark.ml.torch.distributor import TorchDistributor

    gpu = pick_device() == "cuda" if use_gpu is None else use_gpu
    return TorchDistributor(num_processes=processes, local_mode=False, use_gpu=gpu).run(loop, train, **arguments)


def losses(models: dict[str, PipelineModel], valid: DataFrame, label_col: str = "label") -> dict[str, float]:
    evaluator = MulticlassClassificationEvaluator(metricName="logLoss", labelCol=label_col)
    return {name: evaluator.evaluate(model.transform(valid)) for name, model in models.items()}


def select_best(found: dict[str, float]) -> str:
    """The name with the least loss; the first by name of equal ones."""
    return min(sorted(found), key=lambda x: found[x])


def fit_best(train: DataFrame, valid: DataFrame, path: str, rounds: tuple[int, ...] = (1, 5, 20, 50), label_col: str = "label", **how) -> dict[int, float]:
    """Trains for more and more rounds and saves the model whenever its loss on the validation rows is the least so far, as a training loop saves its best
    epoch. Returns the losses by rounds; the model at ``path`` is that of the least."""
    found: dict[int, float] = {}
    for n in rounds:
        model = fit(train, linear_trainer(label_col=label_col, rounds=n, **how))
        found[n] = losses({"": model}, valid, label_col)[""]
        if found[n] == min(found.values()) and list(found.values()).count(found[n]) == 1:
            model.write().overwrite().save(path)
    return found


def log_losses(predictions: DataFrame, model_col: str = "model", label_col: str = "label", positive_col: str = "positive") -> DataFrame:
    """(model, loss, best): each model's mean log loss over rows that have a label and a probability of class 1, and whether it is the least; of
    equal ones the first by name. Probabilities are kept from 0 and 1 by 1e-15."""
    own = F.when(F.col(label_col) == 1, F.col(positive_col)).otherwise(1 - F.col(positive_col))
    rows = predictions.filter(F.col(label_col).isNotNull() & F.col(positive_col).isNotNull())
    found = rows.groupBy(F.col(model_col).alias("model")).agg(F.round(-F.avg(F.log(F.greatest(F.least(own, F.lit(1 - 1e-15)), F.lit(1e-15)))), 9).alias("loss"))
    least = found.agg(F.min(F.struct("loss", "model")).alias("least"))  # a row
    return found.join(F.broadcast(least)).select("model", "loss", (F.struct("loss", "model") == F.col("least")).alias("best"))


def predict(model: PipelineModel, texts: str | DataFrame, text_col: str = "text") -> DataFrame:
    """Predictions for a batch, or for one sentence as a batch of one row."""
    if isinstance(texts, str):
        texts = SparkSession.active().createDataFrame([(texts,)], f"{text_col} string")
    kept = [c for c in texts.columns]
    rows = model.transform(texts.fillna("", [text_col]))
    from pyspark.ml.functions import vector_to_array

    return rows.select(*kept, F.col("prediction").cast("int").alias("prediction"), F.get(vector_to_array("probability"), F.lit(1)).alias("positive"))
