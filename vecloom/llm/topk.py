"""Exact top-k search by tiled matrix products.

Vectors are packed into blocks (ids and a matrix as binary). A tile is one block of queries times one block of rows:
a numpy matrix product, then a partial selection of each query's best. A task folds its tiles into one list of k per
query; lists are merged in a tree of fan-in `fan_in`, so no task reads more than fan_in * k rows of a query.
Queries are broadcast in groups of at most `query_mb`, each group one pass over the rows: memory per task is bounded by
that and by the tile, whatever the number of queries. It is a stated query set against all rows, in blocks.

Scores are exact integers: float32 products where the norms show that every partial sum stays under 2^24, float64
under 2^53, else Python integers (kept within 64 bits).

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors of one length
are compared; ties go to the smaller id; a row is not compared with rows of its own id; repeated query rows count once,
repeated rows each count; fewer than k rows give all; an empty table gives no rows; null ids take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship, stored, table

ROW_BLOCK, QUERY_BLOCK = 4096, 512
HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("part", pa.int64())])
LOW = -(1 << 63)


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) in double; beyond 64 bits it stays at the ends."""
    return np.clip(np.floor(256.0 * values.astype(np.float64)), -9.2233720368547e18, 9.2233720368547e18).astype(np.int64)


def _packer(block: int, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list]] = {}

        def out(key, ids, mats):
            m = np.concatenate(mats) if mats else np.zeros((0, key[0]), np.int64)
            return pa.RecordBatch.from_pydict({"dim": [key[0]], "grp": [key[1]], "ids": [np.concatenate(ids).tobytes()], "mat": [m.astype("<i8").tobytes()]}, pa.schema([("dim", pa.int64()), ("grp", pa.int64()), ("ids", pa.binary()), ("mat", pa.binary())]))

        for b in batches:
            ids = b["id"].to_numpy(zero_copy_only=False).astype("<i8")
            grp = b["grp"].to_numpy(zero_copy_only=False)
            lists = b["v"]
            sizes = np.diff(lists.offsets.to_numpy())
            flat = quantised(lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for dim, g in sorted(set(zip(sizes.tolist(), grp.tolist()))):
                pick = np.flatnonzero((sizes == dim) & (grp == g))
                mat = flat[ends[pick][:, None] + np.arange(dim)] if dim else np.zeros((len(pick), 0), np.int64)
                got = held.setdefault((dim, g), ([], []))
                got[0].append(ids[pick])
                got[1].append(mat)
                while sum(map(len, got[0])) >= block:
                    i, m = np.concatenate(got[0]), np.concatenate(got[1])
                    yield out((dim, g), [i[:block]], [m[:block]])
                    got[0][:], got[1][:] = [i[block:]], [m[block:]]
        for key, (i, m) in held.items():
            if sum(map(len, i)):
                yield out(key, i, m)

    return run


def blocks(df: DataFrame, block: int, grouped: bool = False) -> DataFrame:
    """df(id, v, grp) -> blocks of one vector length and one group."""
    return df.select("id", "v", "grp").mapInArrow(_packer(block, grouped), "dim long, grp long, ids binary, mat binary")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of q and c."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    bound = np.sqrt((q.astype(float) ** 2).sum(1).max()) * np.sqrt((c.astype(float) ** 2).sum(1).max()) * 1.001
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, LOW + 1, -LOW - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k highest by (score, smaller id); ids: one row per row of scores, or shared. LOW marks no candidate."""
    n = scores.shape[1]
    shared = ids.ndim == 1
    if n > 4 * k and shared:
        by_id = np.argsort(ids, kind="stable")
        scores, ids = scores[:, by_id], ids[by_id]
        if (scores > (1 << 40)).any() or (scores[scores != LOW] < -(1 << 40)).any() or n >= 1 << 20:
            order = np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]
        else:
            key = np.where(scores == LOW, -(1 << 62), (scores << 20) - np.arange(n))
            top = np.argpartition(key, n - k, axis=1)[:, n - k :]
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        return np.take_along_axis(scores, order, 1), ids[order]
    full = np.broadcast_to(ids, scores.shape)
    order = np.stack([np.lexsort((full[i], [-int(s) for s in scores[i]] if (scores[i] == LOW).any() else -scores[i]))[:k] for i in range(len(scores))]) if len(scores) else np.zeros((0, min(k, n)), int)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(full, order, 1)


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                dim = b["dim"][i].as_py()
                qraw = b["q_ids"][i].as_py()
                qid, cid = np.frombuffer(qraw, "<i8"), np.frombuffer(b["ids"][i].as_buffer(), "<i8")
                q = np.frombuffer(b["q_mat"][i].as_buffer(), "<i8").reshape(len(qid), dim)
                c = np.frombuffer(b["mat"][i].as_buffer(), "<i8").reshape(len(cid), dim)
                s = products(q, c)
                s[qid[:, None] == cid[None, :]] = LOW
                got = best(s, cid, k)
                if qraw in kept:
                    old = kept[qraw]
                    got = best(np.concatenate([old[0], got[0]], 1), np.concatenate([old[1], got[1]], 1), k)
                kept[qraw] = got
        for qraw, (s, i) in kept.items():
            qid = np.repeat(np.frombuffer(qraw, "<i8"), s.shape[1])
            s, i = s.ravel(), i.ravel()
            ok = s != LOW
            yield pa.RecordBatch.from_pydict({"query_id": qid[ok], "vec_id": i[ok], "score": s[ok], "part": np.full(int(ok.sum()), part, np.int64)}, HIT)

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, query_mb: int = 64, fan_in: int = 32) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    usable = F.col(id_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shape = lambda d: d.where(F.col(vec_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    q = shape(queries).dropDuplicates(["id"])
    size = q.agg(F.sum(F.size("v") * 8 + 8).alias("b")).first()["b"] or 0
    groups = max(1, -(-size // (query_mb << 20)))
    qblocks = stored(blocks(q.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups))).repartition(max(1, groups), "grp"), QUERY_BLOCK), "queries")
    cblocks = blocks(shape(vectors).withColumn("grp", F.lit(0).cast("long")), ROW_BLOCK).drop("grp")
    out = None
    for g in range(groups):
        these = qblocks.where(F.col("grp") == g).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
        tiles = cblocks.join(F.broadcast(these), F.col("dim") == F.col("q_dim")).select("dim", "ids", "mat", "q_ids", "q_mat")
        hits = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score long, part long")
        out = hits if out is None else out.unionByName(hits)
    out = stored(out, "hits")
    parts = (out.agg(F.max("part")).first()[0] or 0) + 1
    order = [F.col("score").desc(), F.col("vec_id")]
    while parts > fan_in:
        parts = -(-parts // fan_in)
        out = out.withColumn("part", F.floor(F.col("part") / fan_in))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, "vec_id", "embedding")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
