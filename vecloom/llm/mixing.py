"""Mixing sources to target weights by the cube method (balanced sampling).

Every document of a source gets the same expected multiplicity m = target / source size. Its whole part is certain;
its fraction is an inclusion probability. The flight phase moves the probabilities of three documents at a time along
the null space of two constraints (document total, token total) until they are 0 or 1, keeping both totals. It runs in
blocks of a source (so a source with a third of all rows is many tasks); each block leaves at most five undecided
documents (three of them kept out of flight, spread over the sizes), which meet in larger and larger blocks until one small landing problem per source remains: the two documents
that the last flight leaves and a few it was kept from, spread over the sizes. Landing takes the subset of these that
comes nearest to the tokens still due.

Targets come from water filling over the table of sources (one row per source), by running sums over ranges of it, so that
a source per host is no burden; they are joined back by a broadcast whose rows are counted. Everything after the first
scan works on (id, source, size) rows. Rows are dealt to blocks by a hash of id and size; repeated rows, which would all
meet in one block, by a number of their own too.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are taken
with count balance only; repeated rows are separate documents; ties are broken by id, then size, so reruns agree; an
empty table gives no rows; extra columns are carried by `mix_documents` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import prefix_sums
from ._shared import lookup, ship, stored, table, whole_row

WEIGHTS = (5, 2, 1)
WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_ROWS = 1024
LANDING_ROWS = 14


def words(text) -> F.Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size): shares by weight, capped at most * size, excess reshared."""
    per = stored(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    every = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all")).first()["all"] * share
    ranked = prefix_sums(per, [F.col("source").asc_nulls_last()], {"at": F.lit(1).cast("long")})
    w = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("w", w).withColumn("cap", most * F.col("source_size")), "weighed")
    all_w = ranked.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"]
    # sources in order of cap per weight are capped up to a point; the first that isn't gives everybody's level
    ranked = prefix_sums(ranked.withColumn("steep", F.col("cap") / F.col("w")), ["steep", "at"], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    ranked = stored(ranked.withColumn("level", (F.lit(every) - F.col("cap_before")) / (F.lit(all_w) - F.col("w_before"))), "levels")
    level = ranked.where(F.col("level") * F.col("w") < F.col("cap")).agg(F.min(F.struct("steep", "at", "level"))["level"].alias("level")).first()["level"]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def flight(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Move probabilities until at most two are strictly between 0 and 1, keeping sum(p) and sum(p * x)."""
    p = p.astype(float).copy()
    rng = np.random.Generator(np.random.PCG64(seed))
    draws = rng.random(2 * len(p) + 8)
    eps, k = 1e-9, 0
    ps, xs = p.tolist(), x.tolist()
    waiting = [i for i in range(len(ps)) if eps < ps[i] < 1 - eps]
    waiting.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            break
        a, b, c = held
        u, v, w = xs[b] - xs[c], xs[c] - xs[a], xs[a] - xs[b]
        if u == 0 and v == 0 and w == 0:
            u, v, w = 1.0, -1.0, 0.0
        up = down = float("inf")
        for i, d in ((a, u), (b, v), (c, w)):
            if d > 0:
                up, down = min(up, (1 - ps[i]) / d), min(down, ps[i] / d)
            elif d < 0:
                up, down = min(up, ps[i] / -d), min(down, (1 - ps[i]) / -d)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        ps[a], ps[b], ps[c] = ps[a] + step * u, ps[b] + step * v, ps[c] + step * w
        left = []
        for i in held:
            if ps[i] <= eps:
                ps[i] = 0.0
            elif ps[i] >= 1 - eps:
                ps[i] = 1.0
            else:
                left.append(i)
        if len(left) == 3:  # rounding kept all three inside: settle the nearest
            i = min(left, key=lambda j: min(ps[j], 1 - ps[j]))
            ps[i] = round(ps[i])
            left.remove(i)
        held = left
    return np.array(ps)


def landing(p: np.ndarray, x: np.ndarray, due: float) -> np.ndarray:
    """0/1 for at most LANDING_ROWS undecided documents: the subset whose tokens come nearest to `due`, its count weighing in."""
    n = len(p)
    masks = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(masks @ x.astype(float) - due) + 0.01 * max(1.0, float(x.mean())) * np.abs(masks.sum(1) - p.sum())
    return masks[int(off.argmin())].astype(float)


def reserve(x: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Positions of up to n undecided documents, spread over the sizes, that the last flight leaves for landing."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    by_size = open_[np.argsort(x[open_], kind="stable")]
    return by_size[np.unique(np.linspace(0, len(by_size) - 1, min(n, len(by_size))).astype(int))] if len(by_size) else by_size


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def _fly_block(last: bool, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "size", "n"], na_position="last", kind="stable")
        p, x = pdf["p"].to_numpy(), pdf["size"].to_numpy()
        seed = _seed(level, str(pdf["source"].iloc[0]), int(pdf["block"].iloc[0]), len(pdf))
        flying = np.ones(len(p), bool)
        flying[reserve(x, p, LANDING_ROWS - 2 if last else 3 * (len(p) >= 8))] = False
        out = p.copy()
        out[flying] = flight(p[flying], x[flying], seed)
        if not last:
            return pdf.assign(p=out)
        open_ = np.flatnonzero((out > 0) & (out < 1))
        settled = np.setdiff1d(np.arange(len(p)), open_)
        if len(open_):
            out[open_] = landing(out[open_], x[open_], float((p * x).sum() - (out[settled] * x[settled]).sum()))
        return pdf.assign(p=out)

    return run


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, source, size, n) -> plus source_size, target, copies (whole times the row is taken). n: any number that tells rows apart."""
    ship(sizes.sparkSession)
    sizes = stored(sizes.withColumn("own", F.monotonically_increasing_id()), "sizes")
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    same = F.col("t.source").eqNullSafe(F.col("s.source"))
    joined = sizes.alias("s").join(lookup(targets).alias("t"), same).select("s.*", "source_size", "target")
    m = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("m", m).withColumn("base", F.least(F.floor("m"), F.lit(int(most)))).withColumn("p", F.col("m") - F.col("base"))
    h = F.xxhash64("id", "size", "n")
    again = stored(sizes.groupBy(h.alias("h")).count().where("count > 1").select("h"), "repeated")
    if again.limit(1).count():
        joined = joined.withColumn("h", h).join(lookup(again), "h", "left_semi").withColumn("h", F.xxhash64("h", "own")).unionByName(joined.withColumn("h", h).join(lookup(again), "h", "left_anti"))
    else:
        joined = joined.withColumn("h", h)
    p = F.when(F.col("p") < 1e-9, 0.0).when(F.col("p") > 1 - 1e-9, 1.0).otherwise(F.col("p")).alias("p")
    rows = joined.select("id", "source", "size", "n", "source_size", "target", "base", p, "h")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    settled, undecided, level = [rows.where(~open_)], rows.where(open_), 0
    while True:
        per = undecided.groupBy("source").agg(F.count(F.lit(1)).alias("rows_of"))
        per = stored(per.withColumn("blocks", F.ceil(F.col("rows_of") / block_rows).cast("long")), f"blocks{level}")
        most_blocks = per.agg(F.max("blocks")).first()[0]
        if most_blocks is None:
            break
        last = most_blocks <= 1
        b = lookup(per).alias("b")
        dealt = undecided.alias("u").join(b, F.col("u.source").eqNullSafe(F.col("b.source"))).select("u.*", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")).alias("block"))
        schema = "id long, source string, size long, n long, source_size long, target double, base long, p double, h long, block long"
        flown = dealt.groupBy("source", "block").applyInPandas(_fly_block(last, level), schema).drop("block")
        flown = stored(flown, f"flown{level}")
        if last:
            settled.append(flown)
            break
        settled.append(flown.where(~open_))
        undecided, level = flown.where(open_), level + 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.withColumn("copies", F.col("base") + F.col("p").cast("long"))


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.lit(0).cast("long").alias("n"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken (0, 1 or 2), with all its columns. Rows with one id,
    source, size and text hash share one decision per row through their rank."""
    key = F.xxhash64(F.col(text_col))
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), key.alias("n"))
    taken = mix(narrow, **options).groupBy("id", "source", "size", "n").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows_like"))
    taken = stored(taken.where("copies > 0 or rows_like > 1"), "taken")
    rows = df.select(whole_row(df), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), key.alias("n"))
    one = taken.where("rows_like = 1").select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("n").alias("k"), "copies", "rows_like")
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("n") == F.col("k"))
    out = rows.join(lookup(one), same).select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc")
    more = taken.where("rows_like > 1").select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("n").alias("k"), "copies")
    if more.limit(1).count():  # repeated rows: they are alike, so one stands for all copies taken
        first = rows.join(lookup(more), same).dropDuplicates(["id", "source", "n"])
        out = out.unionByName(first.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc"))
    return out.select("doc.*")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(_sizes(docs, "doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
