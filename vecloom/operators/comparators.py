"""Comparators of the int8 search: scalar quantizers with a float query, product quantization, inverted files.

Scalar quantizers keep one code of 0 to 255 per component and ranges per dimension (`per_dim`) or one range for all;
queries stay float, and scores are inner products with the decoded vectors. Product quantization cuts a vector into m
slices, keeps for each slice the nearest of 16 centroids (4 bits), and adds up table entries of query and code. An
inverted file deals vectors to nlist cells by their nearest centroid (inner products are searched, distances assign),
codes what is left after the centroid, and asks only the nprobe best cells of each query.

Codebooks and cells are fitted on at most `sample` vectors, chosen by a hash of their id; every vector is coded. Codes
are columns, so an index can be written with any sink; models are small (16 x dim floats, and nlist x dim).

Defined cases: invalid vectors (null, wrong length, null or non-finite components) take no part; a range of width 0
decodes to its minimum; fewer sampled vectors than centroids repeat some of them; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..runtime import ship
from . import search as S

CENTROIDS, SAMPLE, ROUNDS = 16, 20_000, 20


def _valid(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.select("id", "v").where(~V.invalid(F.col("v"), dim))


def ranges(vectors: DataFrame, dim: int, per_dim: bool) -> DataFrame:
    """One row: lo and step (arrays of dim doubles) over all valid vectors. One pass with partial aggregates."""
    v = _valid(vectors, dim)
    if not per_dim:
        one = v.agg(F.min(F.array_min("v")).cast("double").alias("lo"), F.max(F.array_max("v")).cast("double").alias("hi"))
        return one.select(F.array_repeat("lo", dim).alias("lo"), F.array_repeat((F.col("hi") - F.col("lo")) / 255, dim).alias("step"))
    at = [F.col("v")[i].cast("double") for i in range(dim)]
    got = v.agg(*[F.min(x).alias(f"lo{i}") for i, x in enumerate(at)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(at)])
    lo, hi = [F.col(f"lo{i}") for i in range(dim)], [F.col(f"hi{i}") for i in range(dim)]
    return got.select(F.array(*lo).alias("lo"), F.array(*[(h - x) / 255 for x, h in zip(lo, hi)]).alias("step"))


def scalar_index(vectors: DataFrame, dim: int, per_dim: bool = True) -> DataFrame:
    """(id, code array<int> of 0 to 255, lo, step)."""
    r = ranges(vectors, dim, per_dim)
    x = _valid(vectors, dim).crossJoin(F.broadcast(r))  # r is one row
    near = F.transform(F.arrays_zip("v", "lo", "step"), lambda z: F.when(z["step"] > 0, F.floor((z["v"].cast("double") - z["lo"]) / z["step"] + 0.5)).otherwise(0).cast("int"))
    return x.select("id", near.alias("code"), "lo", "step")


def decoded(index: DataFrame) -> DataFrame:
    """(id, v): the vectors that the codes stand for."""
    return index.select("id", F.transform(F.arrays_zip("code", "lo", "step"), lambda z: z["lo"] + z["code"] * z["step"]).alias("v"))


def search_scalar(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score) of float queries (qid, v) against the decoded vectors."""
    return S.search_exact(decoded(index), queries, k)


def lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids of the rows of x: k-means from evenly spaced starts of the sorted rows, the same on every run."""
    first = x[np.lexsort(x.T[::-1])]
    c = first[np.linspace(0, len(x) - 1, k).round().astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if np.array_equal(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass
class PQModel:
    """books: m x 16 x (dim / m); cells: nlist x dim (one cell of zeros without an inverted file)."""

    books: np.ndarray
    cells: np.ndarray

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its m codes."""
        cell = nearest(x, self.cells)
        rest = x - self.cells[cell]
        m, _, width = self.books.shape
        return cell, np.stack([nearest(rest[:, i * width : (i + 1) * width], self.books[i]) for i in range(m)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """m x 16 inner products of a query's slices with the centroids."""
        m, _, width = self.books.shape
        return np.einsum("mcw,mw->mc", self.books, q.reshape(m, width))


def fit_pq(vectors: DataFrame, dim: int, m: int, nlist: int = 1, sample: int = SAMPLE) -> PQModel:
    """Fit on at most about `sample` valid vectors, those of the lowest hashes of their ids."""
    if dim % m:
        raise ValueError("m must divide dim")
    v = _valid(vectors, dim)
    x = np.array([r["v"] for r in v.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.float64).reshape(-1, dim)
    if not len(x):
        return PQModel(np.zeros((m, CENTROIDS, dim // m)), np.zeros((nlist, dim)))
    cells = lloyd(x, nlist) if nlist > 1 else np.zeros((1, dim))
    rest, width = x - cells[nearest(x, cells)], dim // m
    return PQModel(np.stack([lloyd(rest[:, i * width : (i + 1) * width], CENTROIDS) for i in range(m)]), cells)


def pq_index(vectors: DataFrame, model: PQModel) -> DataFrame:
    """(id, cell, code): every valid vector; code holds one centroid number a byte."""
    dim = model.dim
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code = model.encode(_rows(b, dim))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "cell", "code"])

    return _valid(vectors, dim).select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, cell int, code binary")


def search_pq(index: DataFrame, queries: DataFrame, model: PQModel, k: int, nprobe: int | None = None) -> DataFrame:
    """(qid, rank, id, score): float queries (qid, v); with nprobe, only the cells of the highest inner products.

    Queries go to the tasks in groups of GROUP; each task keeps k a query, and a window with a partial limit merges."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, m = index.sparkSession, model.books.shape[0]
    ship(spark)
    probe = len(model.cells) if nprobe is None else max(1, min(nprobe, len(model.cells)))
    asked = _valid(queries.withColumnRenamed("qid", "id"), model.dim)
    groups, parts = max(1, -(-asked.count() // S.GROUP)), None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect()
        if not rows:
            continue
        qid = np.array([r["id"] for r in rows], np.int64)
        q = np.array([r["v"] for r in rows], np.float64)
        part = _probed(index, model, qid, q, m, k, probe)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "qid long, rank long, id long, score double")
    return S.ranked(parts, k)


def reranked(hits: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(qid, rank, id, score): the k best of each query's hits by inner products of the full vectors, in double."""
    q = _valid(queries.withColumnRenamed("qid", "id"), dim).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    full = hits.select("qid", "id").distinct().join(q, "qid").join(_valid(vectors, dim), "id")
    return S.ranked(full.select("qid", "id", V.float_dot(F.col("qv"), F.col("v")).alias("score")), k)


def _probed(index: DataFrame, model: PQModel, qid: np.ndarray, q: np.ndarray, m: int, k: int, probe: int) -> DataFrame:
    coarse = q @ model.cells.T
    wanted = np.zeros(coarse.shape, bool)
    np.put_along_axis(wanted, np.argsort(-coarse, axis=1, kind="stable")[:, :probe], True, axis=1)
    luts = np.stack([model.tables(x) for x in q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(qid)
        for b in batches:
            if not b.num_rows:
                continue
            ids, cell = b["id"].to_numpy(), b["cell"].to_numpy()
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, m)
            for i in range(len(qid)):
                at = np.flatnonzero(wanted[i][cell])
                s = np.concatenate([top[i][0], coarse[i][cell[at]] + luts[i][np.arange(m), code[at]].sum(1)])
                n = np.concatenate([top[i][1], ids[at]])
                best = np.lexsort((n, -s))[:k]
                top[i] = s[best], n[best]
        size = [len(s) for s, _ in top]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, size)), pa.array(np.concatenate([n for _, n in top])), pa.array(np.concatenate([s for s, _ in top]))], ["qid", "id", "score"])

    some = np.flatnonzero(wanted.any(0))
    held = index.where(F.col("cell").isin(some.tolist())) if len(some) < len(model.cells) else index
    return held.mapInArrow(run, "qid long, id long, score double")
