"""Session settings shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session, unless they find it on their path."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in paths or context.applicationId in _SHIPPED or context.master.startswith("local[") and Path.cwd() == ROOT:
        return
    archive = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((ROOT / "marlstone").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "marlstone", cores: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session; on a cluster, pass the session of the cluster to the operators instead."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
