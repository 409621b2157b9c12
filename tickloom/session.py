"""Sessions and the canonical tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; sizes are left to the cluster's settings."""
    builder = SparkSession.builder.master(master).appName("tickloom")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package where they could not import it: once for each application, by Spark's own file server."""
    home = Path(__file__).resolve().parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    application = spark.sparkContext.applicationId
    if application in _SHIPPED or any(p and Path(p).resolve() == home.parent for p in known):
        return
    path = f"{tempfile.mkdtemp(prefix='tickloom-code-')}/tickloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on one machine (tests), where none is named, one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that a lost executor costs nothing before."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Whole microseconds since 1970 of a timestamp column."""
    return F.expr(MICROS.format(column))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a trace: rank, ts (us), tid, cpu, type, value, props; cents is the value in whole hundredths, k a field of props."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rank"), micros("ts").alias("ts"), F.col("user_id").alias("tid"), (F.col("user_id") % 4).alias("cpu"), F.col("event_type").alias("type"), "value", "props", F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )
