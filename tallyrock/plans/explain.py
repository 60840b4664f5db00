"""EXPLAIN: Spark's own plan, one line a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """line (from 1) and plan of a DataFrame; nothing of it is run."""
    spark = df.sparkSession
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), "\n")).alias("line", "plan")).withColumn("line", F.col("line") + 1)
