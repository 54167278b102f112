"""Session defaults and reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "kinfold", **conf: str) -> SparkSession:
    """A session with the engine's defaults; anything in `conf` (dots as __) goes over them."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a local session may
    lack the setting; it then gets one temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _OWN
    _OWN = _OWN or tempfile.mkdtemp(prefix="kinfold-")
    return _OWN


_OWN = ""


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the plan with a checkpoint in the shared folder, so a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
