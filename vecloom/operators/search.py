"""Exhaustive vector search on DataFrames: index rows (id, codes, scale), queries (qid, codes, scale).

Two strategies, same results. `native`: the queries, whose rows are counted first, are broadcast and scored by higher-order
functions. `blocked` (default): rows and queries are packed into blocks; the query blocks are written to the shared folder
and broadcast in groups of at most GROUP queries and GROUP_MB; a tile is one product of two blocks, of which each query's
best are selected by a partial partition; a task keeps k a query, and a window with a partial limit merges. Ties go to the
smaller id. Float search is tiled likewise; what may be among the best is scored again in a fixed order of addition, so
that equal vectors have equal scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..runtime import ship, written

GROUP, GROUP_MB, ROW_BLOCK, QUERY_BLOCK = 2048, 64, 4096, 512
NATIVE_QUERIES, MAX_K, MAX_FETCH, MAX_QUERY = 1000, 100, 400, 512


def build_index(df: DataFrame, id_col: str, vec_col: str, rounding: str = "away", dim: int | None = None) -> DataFrame:
    """(id, codes, scale). With dim, invalid vectors raise when the rows are computed."""
    v = F.col(vec_col)
    if dim is not None:
        v = F.when(V.invalid(v, dim), F.raise_error(F.lit("invalid vector"))).otherwise(v)
    s = df.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("scale", V.scale(F.col("v")))
    return s.select("id", V.codes(F.col("v"), F.col("scale"), rounding).alias("codes"), "scale")


def from_codes(df: DataFrame, dim: int) -> DataFrame:
    """Adopt (id, codes, scale) made elsewhere after checking lengths and the code range."""
    bad = (F.size("codes") != dim) | F.exists("codes", lambda c: c.isNull() | (c == -128)) | F.col("scale").isNull()
    return df.select("id", F.when(bad, F.raise_error(F.lit("invalid codes"))).otherwise(F.col("codes")).alias("codes"), "scale")


BLOCK = "ids binary, scales binary, mat binary"
HIT = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _packer(block: int, kind: str):
    """(id, scale, v) -> blocks of up to `block` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                x = b.slice(at, block)
                mat = x["v"].flatten().to_numpy(zero_copy_only=False).astype(kind)
                cols = [x[n].to_numpy(zero_copy_only=False).astype(t).tobytes() for n, t in (("id", "<i8"), ("scale", "<f4"))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (*cols, mat.tobytes())], ["ids", "scales", "mat"])

    return run


def _int_scores(q: np.ndarray, qs: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    wide = np.float32 if q.shape[1] <= 1040 else np.float64  # 127^2 * 1040 < 2^24: float32 products of codes are exact
    return ((q.astype(wide) @ m.astype(wide).T).astype(np.float32) * qs[:, None] * s[None, :]).astype(np.float64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _tiles(k: int, kind: str, own: bool):
    """Tiles of a row block and a query block -> the best k a query of all tiles of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                qid, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q, m = (np.frombuffer(r[c], kind).reshape(n, -1) for c, n in (("q_mat", len(qid)), ("mat", len(ids))))
                if kind == "<i1":
                    s, slack = _int_scores(q, np.frombuffer(r["q_scales"], "<f4"), m, np.frombuffer(r["scales"], "<f4")), np.zeros(len(qid))
                else:
                    s, slack = q @ m.T, 1e-12 * np.sqrt((q * q).sum(1) * (m * m).sum(1).max())
                if own:
                    s[qid[:, None] == ids[None, :]] = -np.inf
                least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(qid), -np.inf)
                for i, name in enumerate(qid.tolist()):
                    at = np.flatnonzero((s[i] >= least[i] - slack[i]) & (s[i] > -np.inf))
                    score = s[i, at] if kind == "<i1" else np.cumsum(q[i] * m[at], axis=1)[:, -1]
                    old = top.get(name)
                    top[name] = _best(ids[at], score, k) if old is None else _best(np.concatenate([old[0], ids[at]]), np.concatenate([old[1], score]), k)
        for name, (ids, score) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name)), pa.array(ids), pa.array(score)], schema=HIT)

    return run


def _tiled(rows: DataFrame, queries: DataFrame, k: int, kind: str, own: bool) -> DataFrame:
    """rows and queries (id, scale, v) -> ranked hits."""
    ship(rows.sparkSession)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v") * (1 if kind == "<i1" else 8) + 12).alias("b")).first()
    groups = max(1, -(-size["n"] // GROUP), -(-(size["b"] or 0) // (GROUP_MB << 20)))
    names = [F.col(c).alias(f"q_{c}") for c in ("ids", "scales", "mat")]
    parts = [queries.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).coalesce(1).mapInArrow(_packer(QUERY_BLOCK, kind), BLOCK).withColumn("grp", F.lit(g)) for g in range(groups)]
    asked = written(reduce(DataFrame.unionByName, parts), "queries")
    blocks = rows.mapInArrow(_packer(ROW_BLOCK, kind), BLOCK)
    hits = [blocks.crossJoin(F.broadcast(asked.where(F.col("grp") == g).select(*names))).mapInArrow(_tiles(k, kind, own), "qid long, id long, score double") for g in range(groups)]  # of checked size
    return ranked(reduce(DataFrame.unionByName, hits), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def search(index: DataFrame, queries: DataFrame, k: int, strategy: str = "blocked", exclude_own: bool = False) -> DataFrame:
    """(qid, rank, id, score): the k highest int8 inner products, rescaled, of each query."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy == "native":
        if queries.limit(NATIVE_QUERIES + 1).count() > NATIVE_QUERIES:
            raise ValueError(f"native search takes at most {NATIVE_QUERIES} queries; use blocked")
        q = queries.select("qid", F.col("codes").alias("q_codes"), F.col("scale").alias("q_scale"))
        pairs = index.crossJoin(F.broadcast(q))
        if exclude_own:
            pairs = pairs.where("id <> qid")
        return ranked(pairs.select("qid", "id", V.rescale(V.int_dot(F.col("q_codes"), F.col("codes")), F.col("q_scale"), F.col("scale")).alias("score")), k)
    shape = lambda d, name: d.select(F.col(name).cast("long").alias("id"), "scale", F.col("codes").alias("v"))
    return _tiled(shape(index, "id"), shape(queries, "qid"), k, "<i1", exclude_own).withColumn("score", F.col("score").cast("float"))


def search_exact(vectors: DataFrame, queries: DataFrame, k: int, exclude_own: bool = False) -> DataFrame:
    """The same with float vectors (id, v), (qid, v) of one length: the ground truth, in double."""
    if k < 1:
        raise ValueError("k must be at least 1")
    shape = lambda d, name: d.select(F.col(name).cast("long").alias("id"), F.lit(1.0).cast("float").alias("scale"), F.col("v").cast("array<double>").alias("v"))
    return _tiled(shape(vectors, "id"), shape(queries, "qid"), k, "<f8", exclude_own)


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows per query, missing ones as id -1 and score -inf."""
    grid = queries.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    out = grid.join(results, ["qid", "rank"], "left")
    return out.select("qid", "rank", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("score", F.lit(float("-inf")).cast("float")).alias("score"))


def collapse(ranked_rows: DataFrame, limit: int) -> DataFrame:
    """(qid, rank, id, url, text, ...): in rank order, drop a row whose key (url, else text) or text was already kept.
    A dropped row's key counts for nothing. At most MAX_FETCH rows a query, folded in one array."""
    row = F.struct("rank", "id", F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("text")).alias("key"), "text")
    rows = ranked_rows.where(F.col("rank") <= MAX_FETCH).groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("r"))
    empty = F.expr("cast(array() as array<struct<rank:bigint,id:bigint,key:string,text:string>>)")

    def step(kept, x):
        again = F.exists(kept, lambda y: (y["key"] == x["key"]) | (y["text"] == x["text"]))
        return F.when(again | (F.size(kept) >= limit), kept).otherwise(F.concat(kept, F.array(x)))

    kept = rows.select("qid", F.aggregate("r", empty, step).alias("kept")).select("qid", F.posexplode("kept").alias("at", "x"))
    return kept.select("qid", (F.col("at") + 1).cast("long").alias("shown"), "x.rank", "x.id")


def confidence(results: DataFrame, queries: DataFrame, floor: float = 0.55, unrankable: tuple = ("gutenberg",)) -> DataFrame:
    """qid -> low_confidence, confidence_kind from the first result's source and score."""
    top = results.where("rank = 1").select("qid", "source", "score")
    kind = F.when(F.col("score").isNull(), "empty").when(F.col("source").isin(*unrankable), "unrankable").when(F.col("score") >= floor, "ok").otherwise("noise")
    return queries.select("qid").join(top, "qid", "left").select("qid", (kind != "ok").alias("low_confidence"), kind.alias("confidence_kind"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid -> hits and share of b's first k ids among a's first k."""
    hits = a.where(F.col("rank") <= k).select("qid", "id").join(b.where(F.col("rank") <= k).select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return a.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), (F.coalesce("hits", F.lit(0)) / k).alias("share"))


class VectorIndex:
    """An index and its searches: `VectorIndex.from_floats(df, "id", "embedding").search(queries, 10)`."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim

    @classmethod
    def from_floats(cls, df: DataFrame, id_col: str, vec_col: str, dim: int, rounding: str = "away") -> VectorIndex:
        return cls(build_index(df, id_col, vec_col, rounding, dim), dim)

    @classmethod
    def from_codes(cls, df: DataFrame, dim: int) -> VectorIndex:
        return cls(from_codes(df, dim), dim)

    def quantize_queries(self, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        return build_index(df, id_col, vec_col, dim=self.dim).withColumnRenamed("id", "qid")

    def search(self, queries: DataFrame, k: int = 10, strategy: str = "blocked") -> DataFrame:
        if k > MAX_FETCH:
            raise ValueError(f"k must be at most {MAX_FETCH}")
        return search(self.rows, queries, k, strategy)

    def search_passages(self, queries: DataFrame, passages: DataFrame, k: int = 10) -> DataFrame:
        """k clamped to 1..100, six times as many fetched, copies collapsed, then passages joined to the few rows kept."""
        k = clamped(k)
        hits = search(self.rows, queries, fetch_depth(k))
        kept = shown(hits, passages, k)
        return kept.join(hits.select("qid", "id", "score"), ["qid", "id"]).join(passages, "id")


def clamped(k) -> int:
    return max(1, min(int(k), MAX_K))


def fetch_depth(k: int) -> int:
    return min(6 * k, MAX_FETCH)


def check_query(text: str) -> str:
    """A query's text as it is; blank ones and those of more than MAX_QUERY characters are refused, never cut."""
    if not (text or "").strip():
        raise ValueError("empty query")
    if len(text) > MAX_QUERY:
        raise ValueError(f"query too long: {len(text)} characters, limit {MAX_QUERY}")
    return text


def query_faults(text: Column) -> Column:
    """The same for a column of queries: 'empty', 'too long' or null."""
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[\\s\\x1c-\\x1f]+", " ")) == ""
    return F.when(blank, "empty").when(F.length(text) > MAX_QUERY, "too long")


def shown(hits: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """The k hits a query that are shown: copies collapsed."""
    return collapse(hits.join(passages.select("id", "url", "text"), "id"), k)


def shown_overlap(ours: DataFrame, others: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """qid -> n_shown, shared, same_results (share of what is shown that the others show too, both collapsed alike; null where
    nothing is shown), same_at_depth (share of all fetched ids)."""
    a, b = shown(ours, passages, k), shown(others, passages, k)
    n = a.groupBy("qid").agg(F.count(F.lit(1)).alias("n_shown"))
    same = b.join(n, "qid").where("shown <= n_shown").join(a.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("shared"))
    deep = ours.groupBy("qid").agg(F.count(F.lit(1)).alias("fetched"))
    both = ours.select("qid", "id").join(others.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("both"))
    out = deep.join(n, "qid", "left").join(same, "qid", "left").join(both, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select("qid", zero("n_shown").alias("n_shown"), zero("shared").alias("shared"), F.when(F.col("n_shown") > 0, zero("shared") / F.col("n_shown")).alias("same_results"), (zero("both") / F.col("fetched")).alias("same_at_depth"))
