"""Session settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "tidewrack", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) is a temporary one set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
