"""Language identification by compression: per-language zstandard raw-content dictionaries, smallest length wins.

A bounded sample of training documents per language (`sample_docs` documents, those of the lowest hashes of the id, up to
`sample_chars` characters of each, for the `most_langs` most frequent languages) gives its words, and of scripts without
blanks and of words over LONG_WORD characters the segments of SEGMENT characters; those in at least two documents, the most
frequent last, become a raw-content dictionary of up to `dict_bytes`.
Every whole text is compressed in windows with each dictionary; the language with the smallest total wins, and a text
whose runner-up is nearer than `least_margin` (relative) is rejected. A short window is followed by zeros, which cost
every dictionary alike but keep zstandard from storing it uncompressed, so that single words count.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; ties go to the first language
by name; without any training row every text is `und`; training uses only text and non-null lang of rows outside the
held-out fold; repeated rows are scored each; an empty table gives no rows; extra columns are kept by `keep_identified`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import memo, ship, table, whole_row

SAMPLE_DOCS, SAMPLE_CHARS, MOST_LANGS, DICT_BYTES, WINDOW, SHORT, LEAST_MARGIN = 300, 50_000, 200, 48 << 10, 2048, 256, 0.002
LONG_WORD, SEGMENT = 24, 3
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")  # Thai, Lao, Burmese, Khmer, kana, Han
FILLER = bytes(512)


def fold_of(id_col, n: int):
    """crc32 of the id as text, mod n; null ids count as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def _clean(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _units(text: str) -> set[bytes]:
    """Words; segments where blanks don't part words."""
    out = set()
    for w in text.lower().split():
        runs = [w] if len(w) > LONG_WORD else _UNSPACED.findall(w)
        for run in runs:
            out.update(run[i : i + SEGMENT] for i in range(max(1, len(run) - SEGMENT + 1)))
        if not runs:
            out.add(w)
    return {_clean(w) for w in out}


def dictionary(texts: list[str], dict_bytes: int = DICT_BYTES) -> bytes:
    seen: Counter = Counter()
    for t in texts:
        seen.update(_units(t))
    least, chosen, size = min(2, len(texts)), [], 0
    for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if n < least or size + len(w) + 1 > dict_bytes:
            break
        chosen.append(w)
        size += len(w) + 1
    return b" ".join(reversed(chosen)) + b" "


def train(df: DataFrame, text_col: str, lang_col: str, key, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, sample_chars: int = SAMPLE_CHARS, most_langs: int = MOST_LANGS) -> dict[str, bytes]:
    """lang -> dictionary. key: a column whose hash chooses the sample. The driver holds one language's sample at a time."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(key).alias("h"), F.substring(text_col, 1, sample_chars).alias("t"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_langs)
    likely = F.pmod("h", F.lit(1 << 20)) <= (1 << 20) * F.least(F.lit(1.0), 2 * sample_docs / F.col("n"))  # about twice the sample, so that few texts are sorted
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    chosen = rows.join(F.broadcast(counts), "lang").where(likely).withColumn("at", first).where(F.col("at") <= sample_docs)
    out, texts, now = {}, [], None
    for r in chosen.select("lang", "t").orderBy("lang", "at").toLocalIterator():
        if now is not None and r["lang"] != now:
            out[now], texts = dictionary(list(dict.fromkeys(texts)), dict_bytes), []
        now = r["lang"]
        texts.append(r["t"])
    if now is not None:
        out[now] = dictionary(list(dict.fromkeys(texts)), dict_bytes)
    return out


def compressor(content: bytes) -> zs.ZstdCompressor:
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    p = zs.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=4, target_length=8, strategy=zs.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


def _compressors(model: dict[str, bytes]):
    kept = memo("languages")
    key = tuple((k, hash(v)) for k, v in model.items())
    if key not in kept:
        kept.clear()
        kept[key] = [(k, compressor(v)) for k, v in sorted(model.items())]
    return kept[key]


def identify(text: str | None, model: dict[str, bytes]) -> tuple[str, float, float]:
    """(language, score from 0 to 1, relative margin)."""
    if not text or not model or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0
    data = _clean(text)
    windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
    windows = [w if len(w) >= SHORT else b" " + w + b" " + FILLER for w in windows]
    sizes = sorted((sum(len(c.compress(w)) for w in windows), lang) for lang, c in _compressors(model))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], margin / (margin + 0.02) if margin else 0.0, margin


def _scorer(model: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [identify(t.as_py(), model) for t in b["t"]]
            extra = [b[n] for n in b.schema.names if n != "t"]
            names = [n for n in b.schema.names if n != "t"] + ["lang_pred", "score", "margin"]
            yield pa.RecordBatch.from_arrays([*extra, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], names)

    return run


def identify_rows(df: DataFrame, id_col: str, text_col: str, model: dict[str, bytes]) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(_scorer(model), "doc_id long, lang_pred string, score double, margin double")


def _train_documents(docs: DataFrame) -> dict[str, bytes]:
    learn = docs.where(fold_of(F.col("doc_id"), 5) != 0)
    return train(learn, "text", "lang", F.col("doc_id"))


def keep_identified(docs: DataFrame, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The documents whose language is found, with all their columns; rejects `und` and narrow margins."""
    ship(docs.sparkSession)
    model = _train_documents(docs)
    if not model:
        return docs.limit(0)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        return pd.Series([identify(t, model)[2] >= least_margin for t in texts])

    return docs.select(whole_row(docs), kept(F.col("text")).alias("ok")).where("ok").select("doc.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_rows(docs, "doc_id", "text", _train_documents(docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("margin") < LEAST_MARGIN)).alias("rejected"))
