"""A session for scripts and tests; library functions take the session that they are given."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Settings by environment variable, with the default.
SETTINGS = {
    "spark.master": ("SILTWORKS_MASTER", "local[*]"),
    "spark.driver.memory": ("SILTWORKS_DRIVER_MEMORY", "8g"),
    "spark.driver.maxResultSize": ("SILTWORKS_MAX_RESULT", "2g"),
    "spark.sql.shuffle.partitions": ("SILTWORKS_SHUFFLE_PARTITIONS", "200"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("SILTWORKS_ARROW_ROWS", "20000"),
    "spark.local.dir": ("SILTWORKS_LOCAL_DIR", os.path.join(tempfile.gettempdir(), "siltworks-spark")),
    "spark.checkpoint.dir": ("SILTWORKS_CHECKPOINT_DIR", ""),
}


def session(app: str = "siltworks", **more: str) -> SparkSession:
    """The active session, or a new one in UTC with adaptive execution; ``more`` overrides (dots as ``__``)."""
    conf = {key: os.environ.get(env, default) for key, (env, default) in SETTINGS.items()}
    conf |= {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    conf |= {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(app).config(map={k: v for k, v in conf.items() if v}).getOrCreate()


def is_active() -> bool:
    return SparkSession.getActiveSession() is not None


def stop() -> None:
    if (active := SparkSession.getActiveSession()) is not None:
        active.stop()
