"""Measurement: recall, agreement, order statistics, cost, roofline, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ranking import prefix_sums


def recall(got: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits / (queries * k) over (qid, id)."""
    hits = got.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"], "left_semi").agg(F.count(F.lit(1)).alias("h"))
    nq = truth.agg(F.countDistinct("qid").alias("nq"))
    return hits.crossJoin(nq).select((F.col("h") / (F.col("nq") * k)).alias("recall"))  # two single rows


def order_statistics(df: DataFrame, by: str, x: str) -> DataFrame:
    """Median (mean of the middle two), upper median and p90 (value at int(0.9 n) in order; the last where that is 0).
    Equal values are counted first and ranks come from running sums over ranges, so that one key may hold most rows."""
    counted = df.where(F.col(x).isNotNull()).groupBy(F.col(by).alias("by"), F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    at = prefix_sums(counted, ["by", "x"], {"before": F.col("k")})
    total = at.groupBy("by").agg(F.sum("k").alias("n"), F.min("before").alias("first"))  # one row per key
    r = at.alias("r").join(total.alias("t"), F.col("r.by").eqNullSafe(F.col("t.by"))).select("r.by", "x", "n", (F.col("before") - F.col("first")).alias("lo"), (F.col("before") - F.col("first") + F.col("k")).alias("hi"))
    p90 = F.when(F.floor(F.col("n") * 9 / 10) == 0, F.col("n")).otherwise(F.floor(F.col("n") * 9 / 10))
    value = lambda i: F.max(F.when((F.col("lo") < i) & (i <= F.col("hi")), F.col("x")))
    low, high = value(F.floor((F.col("n") + 1) / 2)), value(F.floor(F.col("n") / 2) + 1)
    return r.groupBy("by").agg(F.max("n").alias("n"), ((low + high) / 2).alias("median"), high.alias("upper_median"), value(p90).alias("p90"), F.min("x").alias("lowest"), F.max("x").alias("highest")).withColumnRenamed("by", by)


def anisotropy(vectors: DataFrame, vec_col: str = "v", sample: int = 4000) -> float:
    """Largest over mean singular value of a centred sample of at most `sample` vectors."""
    import numpy as np

    x = np.array([r[0] for r in vectors.select(vec_col).orderBy(F.xxhash64(vec_col)).limit(sample).collect()], float)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    return float(s[0] / s.mean())


def cost_per_million(rate_per_hour: Column, qps: Column) -> Column:
    return rate_per_hour / qps * 1e6 / 3600


def in_band(recall_: Column, low: float = 0.970, high: float = 0.990) -> Column:
    return recall_.between(low, high)


def roofline(df: DataFrame) -> DataFrame:
    """(kernel, block, n, dpad, nq, seconds) -> qps, gbs (bytes of passes over the data), macs (of all bytes of a pass), and
    speedup over the kernel's run of the same n and nq at the smallest block."""
    per_pass = F.col("n") * (F.col("dpad") + 4)
    out = df.select("kernel", "block", "n", "nq", (F.col("nq") / F.col("seconds")).alias("qps"), (per_pass * F.ceil(F.col("nq") / F.col("block")) / F.col("seconds") / 1e9).alias("gbs"), (per_pass * F.col("nq") / F.col("seconds") / 1e9).alias("macs"))
    first = out.groupBy("kernel", "n", "nq").agg(F.min_by("qps", "block").alias("first"))
    return out.join(first, ["kernel", "n", "nq"]).withColumn("speedup", F.col("qps") / F.col("first")).drop("first")


def kernel_ratio(rates: DataFrame, over: str, under: str) -> DataFrame:
    """(kernel, block, qps) -> per block that both kernels have: qps of `over` / qps of `under`."""
    best = lambda k: F.max(F.when(F.col("kernel") == k, F.col("qps")))
    return rates.groupBy("block").agg((best(over) / best(under)).alias("ratio")).where("ratio is not null")


def best_rates(timings: DataFrame, by: str, nq: int) -> DataFrame:
    """(by, seconds) -> qps: nq over the best of the repeats."""
    return timings.groupBy(by).agg((F.lit(nq) / F.min("seconds")).alias("qps"))


def ratio_range(levels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: lowest and highest ratio a / b over the levels; levels without either, or with b = 0, don't count."""
    r = F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(a) / F.col(b))
    return levels.agg(F.min(r).alias("ratio_min"), F.max(r).alias("ratio_max"))


def gflops(timings: DataFrame, by: str, n: str, seconds: str) -> DataFrame:
    """Products of n x n matrices: 2 n^3 operations over the best and the median time, per (by, n)."""
    flops = 2.0 * F.col(n).cast("double") * F.col(n) * F.col(n) / 1e9
    got = timings.groupBy(by, n).agg(F.min(seconds).alias("best"), F.percentile(seconds, F.lit(0.5)).alias("median"))
    return got.select(by, n, (flops / F.col("best")).alias("gflops_best"), (flops / F.col("median")).alias("gflops_median"))


def best_valid(rows: DataFrame, by: str, rate: str = "qps", recall_: str = "recall", floor: float = 0.5) -> DataFrame:
    """Per `by`, the row of the highest rate among those whose recall is above the floor; by name on ties."""
    order = F.struct(F.col(rate), *[F.col(c) for c in sorted(rows.columns) if c not in (rate, by)])
    best = rows.where(F.col(recall_) > floor).groupBy(by).agg(F.max(F.struct(order.alias("o"), F.struct(*rows.columns).alias("r")))["r"].alias("r"))
    return best.select("r.*")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def paired_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, v) twice -> n and the mean cosine of the vectors of one id."""
    both = a.select("id", V.l2_normalize(F.col("v")).alias("x")).join(b.select("id", V.l2_normalize(F.col("v")).alias("y")), "id")
    return both.select(V.float_dot(F.col("x"), F.col("y")).alias("c")).agg(F.count("c").alias("n"), F.avg("c").alias("cosine"))


def smoke(requests: DataFrame, least_overlap: float = 0.6, least_speedup: float = 1.5, least_n: int = 100, least_sources: int = 2) -> DataFrame:
    """Requests (query, n, sources, returned, text, title, url, source, speedup, same_results: the first result's fields) ->
    (fault, faults): what fails a live index, with how often; no rows when it is sound. A null speedup: the other index did not run."""
    missing = reduce(lambda x, y: x | y, [F.coalesce(F.col(c), F.lit("")) == "" for c in ("text", "title", "url", "source")])
    some = F.coalesce(F.col("returned"), F.lit(0)) > 0
    marks = {
        "index too small": F.col("n") < least_n,
        "too few sources": F.col("sources") < least_sources,
        "no results": ~some,
        "field missing": some & missing,
        "bad url": some & ~F.coalesce(F.col("url"), F.lit("")).startswith("http"),
        "nothing to compare": some & F.col("speedup").isNull(),
        "indexes disagree": some & F.col("speedup").isNotNull() & (F.col("same_results") < least_overlap),
    }
    each = requests.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in marks.items()]), lambda x: x.isNotNull())).alias("fault"))
    slow = requests.where(some & F.col("speedup").isNotNull()).agg(F.avg("speedup").alias("m")).where(F.col("m") < least_speedup).select(F.lit("mean speedup too low").alias("fault"), F.lit(1).cast("long").alias("faults"))
    return each.groupBy("fault").agg(F.count(F.lit(1)).alias("faults")).unionByName(slow)


def write_report(df: DataFrame, path: str) -> None:
    """A report's rows as JSON lines, in one file: reports are short."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def usable(agreement: Column, rate: Column, base_rate: Column, faster: float = 1.0) -> Column:
    """Formats worth having: agreement of at least 0.95 and a higher rate."""
    return (agreement >= 0.95) & (rate > base_rate * faster)


def playback(ms: Column) -> Column:
    return F.when(ms <= 100, "watchable").when(ms <= 250, "interactive").otherwise("slow")
