"""Fitted models on their way to tasks."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def shipped(spark: SparkSession, model):
    """A function that gives `model` inside tasks. Models have sizes fixed by parameters of
    their operators; classes travel by value, so executors need no copy of the package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)
