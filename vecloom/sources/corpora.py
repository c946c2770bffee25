"""Corpus adapters: raw rows -> passages (text, title, url, source, licence). All are lazy DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking
from ..runtime import ship

# Licence of each source, and the markers of plain-text book files.
LICENCES = {
    "wikipedia": "CC BY-SA 4.0",
    "stackexchange": "CC BY-SA 4.0",
    "arxiv": "arXiv metadata (CC0) / abstracts per arXiv terms",
    "gutenberg": "Public domain",
}
BOOK_START = "(?isU)\\*\\*\\*\\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\\*\\*\\*"
BOOK_END = "(?iU)\\*\\*\\*\\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
BOOK_TITLE = "(?iU)Project Gutenberg (?:eBook|EBook|etext)[,:]?\\s*(?:of\\s+)?(.+)"
BOOK_NOISE = "(?i)(project gutenberg|e-?text prepared|produced by|proofreading team|transcriber's note|http://www\\.pgdp\\.net|archive\\.org/details)"
# End of fixed values.

ANSWERS = "array<struct<text:string,selected:boolean,pm_score:int>>"


def _passages(df: DataFrame, pieces: Column, title: Column, url: Column, source: str) -> DataFrame:
    return df.select(F.explode(pieces).alias("text"), title.alias("title"), url.alias("url"), F.lit(source).alias("source"), F.lit(LICENCES[source]).alias("licence"))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def wikipedia(df: DataFrame) -> DataFrame:
    """(title, url, text)"""
    pulled = F.regexp_replace(_or_empty("text"), T.SPACE_BEFORE, "$1")
    return _passages(df, T.chunk(pulled), _or_empty("title"), _or_empty("url"), "wikipedia")


def best_answer(answers: Column) -> Column:
    """The selected answer, else the highest score; the first of ties. Null when there is none."""
    def key(x, at):
        return F.struct(F.coalesce(x["selected"], F.lit(False)).cast("int").alias("s"), F.coalesce(x["pm_score"], F.lit(0)).alias("p"), (-at).alias("o"), x["text"].alias("text"))

    kept = F.filter(F.transform(answers, lambda x, at: F.when(x.isNotNull(), key(x, at))), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_max(kept))


def stackexchange(df: DataFrame) -> DataFrame:
    """(metadata array<string>, question, answers ANSWERS). Cheap gates come before any HTML work."""
    url = F.coalesce(T.lower_host(F.get("metadata", F.lit(0))), F.lit(""))
    rows = df.withColumn("_url", url).where((F.col("_url") != "") & ~F.col("_url").contains(".meta."))
    rows = rows.withColumn("_best", best_answer(F.col("answers"))).where("_best is not null and (_best.s = 1 or _best.p >= 1)")
    body = T.strip_html(F.coalesce(F.col("_best.text"), F.lit("")))
    pieces = F.filter(T.chunk(body), lambda p: ~T.looks_like_code(p))
    return _passages(rows, pieces, T.headline(T.strip_html(_or_empty("question"))), F.col("_url"), "stackexchange")


def arxiv(df: DataFrame) -> DataFrame:
    """(id, title, abstract)"""
    rows = df.withColumn("_a", T.collapse(_or_empty("abstract"))).where(F.length("_a") >= 120)
    pieces = F.when(F.length("_a") <= 1300, F.array("_a")).otherwise(T.chunk(F.col("_a")))
    return _passages(rows, pieces, T.collapse(_or_empty("title")), F.concat(F.lit("https://arxiv.org/abs/"), _or_empty("id")), "arxiv")


def gutenberg(df: DataFrame) -> DataFrame:
    """(id, text)"""
    book = F.element_at(F.split(_or_empty("id").cast("string"), "-"), 1)
    url = F.when(book.rlike("^[0-9]+$"), F.concat(F.lit("https://www.gutenberg.org/ebooks/"), book)).otherwise(F.lit("https://www.gutenberg.org/"))
    head = F.substring(_or_empty("text"), 1, 2000)
    title = F.when(head.rlike(BOOK_TITLE), T.strip_title(T.trim(F.regexp_extract(head, BOOK_TITLE, 1), 120))).otherwise("Untitled")
    after = F.when(F.col("text").rlike(BOOK_START), F.array_join(F.slice(F.split("text", BOOK_START, 2), 2, 1), "")).otherwise(_or_empty("text"))
    rows = df.withColumn("_b", F.element_at(F.split(after, BOOK_END, 2), 1))
    body = F.expr("substring(_b, least(5000, length(_b) div 10) + 1)")
    pieces = F.filter(T.chunk(T.clean_plain_text(body)), lambda p: ~p.rlike(BOOK_NOISE) & T.is_prose(p))
    return _passages(rows, pieces, title, url, "gutenberg")


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"wikipedia": wikipedia, "stackexchange": stackexchange, "arxiv": arxiv, "gutenberg": gutenberg}


def read_shards(spark: SparkSession, path: str, schema: str, seed: int = 20260728) -> DataFrame:
    """Parquet shards with unreadable ones skipped, and the order in which a sampler reads them: `_shard`, a seeded hash of the
    shard's name, then `_row`, the row's place in it."""
    df = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    return df.select("*", F.xxhash64(F.lit(seed), F.col("_metadata.file_name")).alias("_shard"), F.col("_metadata.row_index").alias("_row"))


def take_shards(shards: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows of read_shards in its order, shard after shard; None or 0: all."""
    return shards.orderBy("_shard", "_row").limit(limit) if limit else shards


def stream(sources: dict[str, DataFrame], order: str, limit: int | None = None) -> DataFrame:
    """The sources' passages as one table with `id`: the first of each in the order given, then the second of each, and so on,
    exhausted ones dropping out; at most `limit` of each. An empty dict has no columns to return and is refused."""
    if not sources:
        raise ValueError("no sources")
    at = [ranking.per_source_limit(df.withColumn("_pos", F.lit(i)), "_pos", order, limit) for i, df in enumerate(sources.values())]
    return ranking.interleave(reduce(DataFrame.unionByName, at), "_pos", order).withColumnRenamed("global_id", "id").drop("_pos")


def write_each(sources: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each source's passages apart, so one that fails leaves the others; returns the failures."""
    failed = {}
    for name, df in sources.items():
        try:
            df.write.mode("overwrite").parquet(f"{path}/source={name}")
        except Exception as e:  # any fault of a source is that source's alone
            failed[name] = str(e)[:500]
    return failed


def loader_chunks(df: DataFrame, text_col: str) -> DataFrame:
    """Adds rows of the plain paragraph loader: (.., at, chunk)."""
    return df.select("*", F.posexplode(T.paragraphs(F.col(text_col))).alias("at", "chunk"))


def wheel_objects(spark: SparkSession, path: str) -> DataFrame:
    """(wheel, object, content): the shared objects inside the packages (zip files) below a path. Unreadable packages raise."""
    ship(spark)

    def run(batches):
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"]):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for x in z.namelist():
                        if x.endswith(".so") or ".so." in x.rsplit("/", 1)[-1]:
                            yield pa.RecordBatch.from_pydict({"wheel": [name.rsplit("/", 1)[-1]], "object": [x], "content": [z.read(x)]}, pa.schema([("wheel", pa.string()), ("object", pa.string()), ("content", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.whl").load(path).select("path", "content")
    return files.mapInArrow(run, "wheel string, object string, content binary")
