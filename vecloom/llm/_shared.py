"""Helpers the training-data operators share: shared-folder tables, checked broadcasts, row wrapping."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime

#: Rows up to which a lookup table of narrow rows (about 50 bytes each) is broadcast; beyond it the plans below take another way.
BROADCAST_ROWS = 1_000_000


#: Rows of an Arrow batch while the session has Spark's own default (10,000): batches of texts stay a few MB.
BATCH_ROWS = 1000
_memo: dict = {"of": None, "entries": {}}


def _give_back() -> None:
    """Return freed memory to the system, as an idle worker's is counted too."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def memo(name: str) -> dict:
    """What a worker remembers between tasks. One operator's at a time: asking for another name forgets the rest."""
    if _memo["of"] != name:
        held = _memo["of"] is not None
        _memo["of"], _memo["entries"] = name, {}
        if held:
            _give_back()
    return _memo["entries"]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers import it wherever they run."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    runtime.ship(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{runtime.shared_dir(spark)}/vecloom-{uuid.uuid4().hex}/{name}"


stored = runtime.written


def dropped(df: DataFrame) -> None:
    """Delete a stored() table that nothing will read again."""
    path = getattr(df, "_vecloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored narrow table is within the checked bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table, hinted for broadcast only when its counted rows are within the bound."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def whole_row(df: DataFrame):
    """All columns as one struct, so that no extra column can clash with ours; `.select('doc.*')` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
