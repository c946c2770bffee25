"""Order-dependent operators: per-source limits, round-robin interleaving, running offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written


def per_source_limit(df: DataFrame, source: str, order: str, n: int | None) -> DataFrame:
    """The first n rows of each source; None or 0: all."""
    if not n:
        return df
    w = Window.partitionBy(source).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def prefix_sums(df: DataFrame, order: list, values: dict) -> DataFrame:
    """Adds, per name in values, the running sum of its column over all rows before this one, in a total order of the rows.

    Rows are dealt to ranges of the order once and written to the shared folder, so that rows and range totals can't come
    from different samplings; the sums are taken inside the ranges, and each range adds the totals of those before it."""
    clash = {*values, "_p"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the table already")
    ranged = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged
    for name, value in values.items():
        out = out.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = ranged.groupBy("_p").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values.values())])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = totals.select("_p", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_t{i}") for i in range(len(values))])
    out = out.join(F.broadcast(bases), "_p")  # one row per range
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_t{i}")).alias(n) for i, n in enumerate(values)])


def interleave(df: DataFrame, source: str, order: str) -> DataFrame:
    """Adds `global_id`: the sources' first rows by source name, then their second rows, and so on. Nulls come first."""
    one = F.lit(1).cast("long")
    ranked = prefix_sums(df, [source, order], {"_at": one})
    first = ranked.groupBy(source).agg(F.min("_at").alias("_first")).withColumnRenamed(source, "_source")  # one row per source
    rounds = ranked.join(first, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_round", F.col("_at") - F.col("_first"))
    return prefix_sums(rounds.drop("_source", "_first", "_at"), ["_round", source], {"global_id": one}).drop("_round")


def byte_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Adds offset_start, offset_end: byte positions of each text in one file ordered by key."""
    n = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return prefix_sums(df, [key], {"offset_start": n}).withColumn("offset_end", F.col("offset_start") + n)


def offset_entries(offsets: DataFrame) -> DataFrame:
    """(entry, offset) of byte_offsets' rows: where each text begins, and the end of the last: one more than texts."""
    starts = prefix_sums(offsets.select("offset_start", "offset_end"), ["offset_start", "offset_end"], {"entry": F.lit(1).cast("long")})
    end = offsets.agg(F.count(F.lit(1)).alias("entry"), F.coalesce(F.max("offset_end"), F.lit(0).cast("long")).alias("offset"))
    return starts.select("entry", F.col("offset_start").alias("offset")).unionByName(end)
