"""Session construction shared by tests, bench and commands."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, name: str = "sonarium", **conf: str) -> SparkSession:
    """A local session with UTC time and a partition count that suits the cores.

    On a cluster the session comes from the submitter; nothing in the library
    depends on the settings made here except the UTC time zone.
    """
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
