"""Sending this package to the executors, and tables in the folder that they share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession | None) -> None:
    """Send the package once per application, so that Python workers import it wherever they run."""
    if spark is None or getattr(spark.sparkContext, "_vecloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vecloom-")) / "vecloom_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._vecloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where that is unset: a folder of our own, in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = getattr(spark.sparkContext, "_vecloom_own_dir", None)
        if not d:
            d = "file://" + tempfile.mkdtemp(prefix="vecloom-shared-")
            spark.sparkContext._vecloom_own_dir = d
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes to the planner.
    In zstd, whose codec works on the heap: the default one's direct buffers stay until the next collection of garbage."""
    path = f"{shared_dir(df.sparkSession)}/vecloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out
