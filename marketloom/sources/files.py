"""Readers and writers: CSV and Parquet tables, feature lists, result records, models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.boosting import Tree, Trees


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header (by `schema`, or inferred) or a Parquet table. NaN in a double becomes NULL."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*(F.nanvl(F.col(c), F.lit(None)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or CSV with a header, in place of what is there."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def write_feature_list(importances: DataFrame, path: str) -> None:
    """One column `feature`, the most important first; ties by name."""
    importances.orderBy(F.desc("importance"), "feature").select("feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(record: DataFrame, path: str) -> None:
    """Configuration and metrics, one JSON object a row; structs nest."""
    record.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """Any fitted pyspark.ml model or pipeline."""
    model.write().overwrite().save(path)


def record_dict(model: Trees | dict) -> dict:
    """A fitted model as plain numbers; lines and scalers are such dictionaries already."""
    if isinstance(model, dict):
        return {"kind": "numbers", "values": model}
    made = [{k: getattr(t, k).tolist() for k in Tree._fields} for t in model.made]
    return {"kind": "trees", "parameters": model.settings(), "cuts": [c.tolist() for c in model.cuts], "base": model.base, "used": model.used.tolist(), "made": made}


def read_record_dict(record: dict) -> Trees | dict:
    """The model that record_dict gave as plain numbers."""
    if record["kind"] == "numbers":
        return record["values"]
    kinds = dict(zip(Tree._fields, (np.int32, np.int32, bool, np.int32, np.int32, float)))
    made = [Tree(**{k: np.array(t[k], dtype=kinds[k]) for k in Tree._fields}) for t in record["made"]]
    return Trees(**record["parameters"], cuts=[np.array(c, dtype=float) for c in record["cuts"]], base=record["base"], used=np.array(record["used"]), made=made)


def save_fitted(spark: SparkSession, model: Trees | dict, path: str) -> None:
    """One of the library's own models, or the numbers of a line or scaler, as one JSON text."""
    spark.createDataFrame([(json.dumps(record_dict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_fitted(spark: SparkSession, path: str) -> Trees | dict:
    """What save_fitted wrote."""
    return read_record_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))
