"""A Spark session with the settings that the library expects, for programs that have none of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName("tessera")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timeType.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()
