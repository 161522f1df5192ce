"""Session defaults."""

from pyspark.sql import SparkSession


def session(name: str = "lexmill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides or adds settings."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
