"""The index on disk: one keyed Parquet table, and a one-row manifest."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators.search import build_index
from ..runtime import written


def write_index(rows: DataFrame, path: str) -> None:
    """(id, codes, scale, text, title, url, source, licence)"""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")


def manifest(rows: DataFrame, model: str = "", seconds: float | None = None) -> DataFrame:
    """One row: n, dim, dpad, per_source, bytes_per_vector, build_seconds, passages_per_second."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("c"), F.max(F.size("codes")).alias("d"))
    one = per.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.max("d").cast("int").alias("dim"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("k"), "c")))).alias("per_source"))
    s = F.lit(seconds).cast("double")
    return one.select("n", "dim", V.pad_dim(F.col("dim")).alias("dpad"), F.lit(model).alias("model"), "per_source", V.bytes_per_vector(F.col("dim")).alias("bytes_per_vector"), s.alias("build_seconds"), (F.col("n") / s).alias("passages_per_second"))


def write_manifest(one: DataFrame, path: str) -> None:
    one.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def build(passages: DataFrame, embed: Callable[[Column], Column], path: str, model: str = "") -> DataFrame:
    """Passages (id, text, title, url, source, licence), as corpora.stream gives them -> a stored index below path, and its
    manifest, which is returned. embed: text column -> array<float> column, such as an iterator Pandas UDF that loads its
    model once a worker; each text is embedded once. Vectors that are null or not finite raise."""
    spark, began = passages.sparkSession, time.monotonic()
    vectors = written(passages.select("id", embed(F.col("text")).alias("v")), "vectors")  # embedding is the dear part: it isn't done again
    one = vectors.agg(F.max(F.size("v")).alias("d")).first()["d"]
    index = build_index(vectors, "id", "v", "even", one or 0)
    write_index(index.join(passages, "id").select("id", "codes", "scale", "text", "title", "url", "source", "licence"), path)
    rows = spark.read.parquet(f"{path}/rows")
    write_manifest(manifest(rows, model, time.monotonic() - began), path)
    return spark.read.json(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/manifest")


def passages_of(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Late materialization: texts are joined to the few ranked ids only."""
    return hits.join(rows.select("id", "text", "title", "url", "source", "licence"), "id")


def search_response(hits: DataFrame) -> DataFrame:
    """qid -> json: ranked results as one document."""
    r = F.sort_array(F.collect_list(F.struct("rank", "id", F.bround(F.col("score").cast("double"), 4).alias("score"), "text", "title", "url", "source", "licence")))
    return hits.groupBy("qid").agg(F.to_json(F.struct(r.alias("results"))).alias("json"))


def repair_titles(spark: SparkSession, path: str, to: str) -> int:
    """Rewrite book titles into a new folder; the number of rows must stay. Returns how many titles changed."""
    rows = spark.read.parquet(f"{path}/rows")
    clean = T.strip_title(F.col("title"))
    fixed = F.when(F.col("source") == "gutenberg", F.when(clean == "", "Untitled").otherwise(clean)).otherwise(F.col("title"))
    rows.withColumn("title", fixed).write.mode("errorifexists").parquet(f"{to}/rows")
    if spark.read.parquet(f"{to}/rows").count() != rows.count():
        raise RuntimeError("title repair changed the number of rows")
    return rows.where(~fixed.eqNullSafe(F.col("title"))).count()
