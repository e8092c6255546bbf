"""Session builder with settings for both local runs and clusters."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scale import tune


def session(app: str = "partmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
