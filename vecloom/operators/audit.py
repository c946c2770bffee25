"""Audit of passages: how often each artifact pattern occurs, and the first example with its surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import per_source_limit


def first_documents(passages: DataFrame, order: str, url: str, docs: int | None, per_doc: int | None) -> DataFrame:
    """The passages that a reader in order sees who stops at the (docs + 1)th document and takes per_doc of each; None: all."""
    if docs:
        seen = passages.groupBy(url).agg(F.min(order).alias("_first")).orderBy("_first").limit(docs + 1)
        if seen.count() > docs:
            passages = passages.where(F.col(order) < seen.agg(F.max("_first")).first()[0])
    return per_source_limit(passages, url, order, per_doc)


def context(t: Column, pattern: str, around: int = 50) -> Column:
    """The first match of the pattern with `around` characters on both sides; null where there is none."""
    at = F.regexp_instr(t, F.lit(pattern))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(t, start, at - start + F.length(F.regexp_substr(t, F.lit(pattern))) + around))


def audit(passages: DataFrame, order: str, url: str, text: str, docs: int | None = None, per_doc: int | None = None, ascii: bool = False) -> DataFrame:
    """One row per label: hits, first (the order of the first hit) and example, null where there is none; beside them the
    numbers of passages and of distinct documents that were read. Null texts have no artifact, null orders are never first.
    ascii: letters, digits, blanks and word boundaries of the patterns are those of ASCII, not of Unicode."""
    rows = first_documents(passages.select(order, url, text), order, url, docs, per_doc)
    found = F.array(*[F.struct(F.lit(k).alias("label"), context(F.col(text), p).alias("example")) for k, p in T.artifact_patterns(ascii).items()])
    each = rows.select(F.col(order).alias("first"), F.explode(F.filter(found, lambda x: x["example"].isNotNull())).alias("x")).select("first", "x.label", "x.example")
    hits = each.groupBy("label").agg(F.count(F.lit(1)).alias("hits"), F.min(F.when(F.col("first").isNotNull(), F.struct("first", "example"))).alias("m"))
    labels = rows.sparkSession.createDataFrame([(k,) for k in T.ARTIFACTS], "label string")
    size = rows.agg(F.count(F.lit(1)).alias("passages"), F.count_distinct(url).alias("documents"))
    out = labels.join(hits, "label", "left").crossJoin(F.broadcast(size))  # size is one row
    return out.select("label", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), F.col("m.first").alias("first"), F.col("m.example").alias("example"), "passages", "documents")
