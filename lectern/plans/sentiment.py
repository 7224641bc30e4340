"""The whole sentiment run: read, drop a field, clean, label, split, save, fit, choose, evaluate, predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import labels, training
from lectern.sources import files


def prepare(df: DataFrame, text_col: str = "review", label_col: str = "label", key_col: str | None = None, fraction: float = 0.2) -> DataFrame:
    """Rows with class labels and a split; the field ``cat`` is gone. Without a key, the text is its own."""
    rows = labels.clean(labels.class_label(labels.drop_column(df, "cat"), label_col), text_col, label_col)
    return labels.stratified_split(rows, label_col, key_col or text_col, fraction)


def run(spark: SparkSession, csv_path: str, work_dir: str, text_col: str = "review", regularisations: tuple[float, ...] = (0.0, 0.01, 0.1), fraction: float = 0.2) -> dict:
    """Trains on a CSV of reviews and returns accuracy on the test part, losses, the best model's name and path. The loss that
    chooses is taken on a part of the training rows, so that the accuracy is not biased by the choice."""
    files.write_dataset(prepare(files.read_reviews(spark, csv_path, text_col), text_col, fraction=fraction), f"{work_dir}/dataset")
    train, test = (files.read_dataset(spark, f"{work_dir}/dataset", x).drop("split") for x in ("train", "test"))
    parts = labels.stratified_split(train, "label", text_col, fraction)
    fitting, valid = (parts.filter(f"split = '{x}'").drop("split") for x in ("train", "test"))
    models = {f"regularisation={x}": training.fit(fitting, training.linear_trainer(text_col, regularisation=x)) for x in regularisations}
    found = training.losses(models, valid)
    best = training.select_best(found)
    files.save_best(models[best], f"{work_dir}/model")
    scored = training.predict(files.load_best(f"{work_dir}/model"), test, text_col)
    return {"accuracy": labels.accuracy(scored).first()["accuracy"], "losses": found, "best": best, "model": f"{work_dir}/model", "device": ",".join(training.devices(spark))}
