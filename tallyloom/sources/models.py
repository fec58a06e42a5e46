"""Fitted models on shared storage, named after their parameters."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# One spelling per family, used by both saving and loading.
FAMILIES = {
    "linear": LinearRegressionModel,
    "tree": DecisionTreeRegressionModel,
    "gbt": GBTRegressionModel,
    "pipeline": PipelineModel,
}


def model_path(root: str, family: str, **params) -> str:
    """``root/family/a=1/b=x``, parameters in name order."""
    if family not in FAMILIES:
        raise ValueError(f"unknown model family {family!r}, one of {sorted(FAMILIES)}")
    return "/".join([root.rstrip("/"), family, *[f"{k}={params[k]}" for k in sorted(params)]])


def save_model(model, root: str, family: str, **params) -> str:
    """Write the model, replacing an older one of the same name."""
    path = model_path(root, family, **params)
    inner = getattr(model, "bestModel", model)
    if not isinstance(inner, FAMILIES[family]):
        raise TypeError(f"{type(inner).__name__} is no {family} model")
    inner.write().overwrite().save(path)
    return path


def load_model(root: str, family: str, **params):
    return FAMILIES[family].load(model_path(root, family, **params))


def save_models(models: DataFrame, root: str, family: str, key: str) -> str:
    """Write a table of models, a row per key, so that the model of a key lies in ``model_path(..., key=value)``."""
    path = model_path(root, family)
    models.write.mode("overwrite").partitionBy(key).parquet(path)
    return path


def load_models(spark: SparkSession, root: str, family: str, schema: StructType) -> DataFrame:
    """The table of all models of a family; ``schema`` keeps the key's type."""
    return spark.read.schema(schema).parquet(model_path(root, family)).select(schema.names)
