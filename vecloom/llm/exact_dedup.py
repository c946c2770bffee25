"""Exact dedup by progressive refinement, DataFrame functions only.

Three passes over the text column, each only as deep as its survivors need: (1) group by byte length, (2) among
lengths that several rows share, group by a hash of a prefix, (3) among rows that share both, hash the full text.
Only lengths, 64-bit hashes and digests are shuffled, and every grouping is a partial aggregate, so a group of copies
with a third of all rows adds one row per task.

The survivors of a pass reach the next scan as a bitmap over hashes of their keys, built by aggregates and broadcast in
buckets of 4 KB: 16 bits a key and at most MOST_BITS (16 MB), whatever the number of keys. A row that passes by chance is
hashed for nothing and found alone in its group; nothing else depends on it. So texts stay where they are scanned.
`drop_exact_copies` moves only rows that share a full hash, and those by (hash, id), which has no hot key.

Defined cases: a null text counts as empty; empty texts equal each other; a null id never wins over a real one and a
group of null ids has keep_id null, all its rows kept; repeated rows (same id and text) are all marked kept by
`exact_groups`, and `drop_exact_copies` keeps one of them; an empty table gives no rows; extra columns, whatever
their names, are carried by `drop_exact_copies` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, lookup, stored, table, whole_row

PREFIX_CHARS, BITS_A_KEY, MOST_BITS, BUCKET_BITS = 256, 16, 1 << 27, 1 << 15


def _bit(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1  # bitmap functions count from 1


def _passing(rows: DataFrame, survivors: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows plus `name`: whether their keys may be among those of `survivors`, a stored table."""
    bits = BUCKET_BITS
    while bits < min(MOST_BITS, BITS_A_KEY * survivors.count()):
        bits *= 2
    marked = survivors.select(_bit(keys, bits).alias("bit"))
    map_ = marked.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    at = rows.withColumn("bit", _bit(keys, bits)).withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("bit", F.bitmap_bit_position("bit"))
    at = at.join(F.broadcast(stored(map_, name)), "bucket", "left")  # at most bits / BUCKET_BITS rows of 4 KB
    byte = F.conv(F.hex(F.expr("substring(map, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
    return at.withColumn(name, F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bit", "map")


def _digested(rows: DataFrame, prefix_chars: int) -> DataFrame:
    """rows(id, t, ...) plus n_bytes, prefix and survives: whether length and prefix hash are shared."""
    rows = rows.withColumn("n_bytes", F.octet_length("t"))
    lengths = stored(rows.groupBy("n_bytes").count().where("count > 1").select("n_bytes"), "lengths")
    rows = _passing(rows, lengths, ["n_bytes"], "shares_length")
    rows = rows.withColumn("prefix", F.when(F.col("shares_length"), F.xxhash64(F.substring("t", 1, prefix_chars))))
    prefixes = rows.where("shares_length").groupBy("n_bytes", "prefix").count().where("count > 1").select("n_bytes", "prefix")
    rows = _passing(rows, stored(prefixes, "prefixes"), ["n_bytes", "prefix"], "shares_prefix")
    return rows.withColumn("survives", F.col("shares_length") & F.col("shares_prefix"))


def _groups(survivors: DataFrame) -> DataFrame:
    """(sha, top_id, copies, repeated) of rows with a full hash: repeated, if rows have one id too."""
    per = survivors.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("sha").agg(F.max("id").alias("top_id"), F.sum("n").alias("copies"), (F.max("n") > 1).alias("repeated"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, max_broadcast_rows: int = BROADCAST_ROWS, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id (largest id among equal texts), group_size, kept, sha (null for rows that no
    full hash was needed for, unless digest_all)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    full = F.sha2("t", 256)
    rows = _digested(rows, prefix_chars)
    groups = stored(_groups(rows.where("survives").select("id", full.alias("sha"))).where("copies > 1").select("sha", "top_id", "copies"), "groups")
    rows = rows.select("id", (full if digest_all else F.when(F.col("survives"), full)).alias("sha"), "n_bytes")
    rows = rows.withColumn("key", F.coalesce("sha", F.concat_ws(" ", "id", "n_bytes")))  # no null keys: they would all meet in one task
    joined = rows.join(lookup(groups.withColumnRenamed("sha", "key"), max_broadcast_rows), "key", "left")
    found = F.col("copies").isNotNull()
    joined = joined.withColumn("keep_id", F.when(found, F.col("top_id")).otherwise(F.col("id")))
    return joined.select("id", "keep_id", F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one stays."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), whole_row(df))
    rows = _digested(rows, prefix_chars)
    alike = rows.where("survives").withColumn("sha", F.sha2("t", 256))
    groups = stored(_groups(alike.select("id", "sha")), "groups")
    tops = lookup(groups.select(F.col("sha").alias("top_sha"), "top_id"), max_broadcast_rows)
    stay = alike.join(tops, (F.col("sha") == F.col("top_sha")) & F.col("id").eqNullSafe(F.col("top_id")), "left_semi")
    if groups.where("repeated").limit(1).count():
        stay = stay.dropDuplicates(["sha", "id"])
    return rows.where("not survives").select("doc").unionByName(stay.select("doc")).select("doc.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs, digest_all=True).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
