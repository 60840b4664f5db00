"""The Spark settings under which the dialect's meaning holds, and SELECT text over named tables."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession

#: ANSI errors instead of silent nulls; exact and quoted identifiers; UTC. GROUP BY and ORDER BY
#: take expressions: no aliases or ordinals in GROUP BY, no ordinals in ORDER BY.
DIALECT = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.groupByAliases": "false",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.orderByOrdinal": "false",
    "spark.sql.session.timeZone": "UTC",
}


def dialect_session(spark: SparkSession) -> SparkSession:
    """A session of its own under ``DIALECT``; the given session keeps its settings and views."""
    own = spark.newSession()
    for key, value in DIALECT.items():
        own.conf.set(key, value)
    return own


def on_tables(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """A dialect session with the named Parquet tables of a folder as views."""
    own = dialect_session(spark)
    for name in names:
        own.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return own


def select(own: SparkSession, sql: str, params: list[Any] | None = None):
    """A SELECT as a lazy DataFrame; each ``?`` takes the next parameter, as a value and never as text."""
    return own.sql(sql, args=list(params or []))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing is at yet, below the folder that driver and executors share (spark.checkpoint.dir).

    Only where all run on this machine may the session name none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir() + '/tallyrock'}/{name}-{uuid.uuid4().hex}"
