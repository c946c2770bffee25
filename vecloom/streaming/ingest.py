"""Structured Streaming forms: stateless ingest of passages, and searches of a stream of queries. Beyond batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search


def ingest(stream: DataFrame, adapter, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Raw rows through a corpus adapter into a Parquet table."""
    return adapter(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def search_stream(index: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of quantized queries against a static index; a batch run again replaces its own output."""

    def each(batch: DataFrame, n: int) -> None:
        search(index, batch, k).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
