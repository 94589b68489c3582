"""Session settings that the engine's plans assume."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "corpusmill", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; cluster sizes are left to the deployment."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all machines share, ``spark.checkpoint.dir``; only a local session gets one made."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/corpusmill/{label}-{uuid.uuid4().hex}"
