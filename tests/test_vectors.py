import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import metrics, ranking, search
from vecloom.operators.search import VectorIndex, build_index


def frame(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{name} long, v array<float>")


def plain_codes(m):
    m = m.astype(np.float32)
    s = np.abs(m).max(1) / np.float32(127)
    s = np.where(s < 1e-30, np.float32(0), s).astype(np.float32)
    inv = np.where(s > 0, np.float32(1) / np.where(s > 0, s, 1), 0).astype(np.float32)
    x = m * inv[:, None]
    return np.clip(np.sign(x) * np.floor(np.abs(x).astype(float) + 0.5), -127, 127).astype(int), s


@pytest.mark.parametrize("d", [8, 16, 17, 127])
def test_strategies_agree_with_numpy(spark, d):
    rng = np.random.default_rng(400 + d)
    base, q = rng.uniform(-1, 1, (57, d)), rng.uniform(-1, 1, (5, d))
    c, s = plain_codes(base)
    qc, qs = plain_codes(q)
    score = ((qc @ c.T).astype(np.float32) * qs[:, None]).astype(np.float32) * s[None, :]
    index = VectorIndex.from_floats(frame(spark, base), "id", "v", d)
    queries = index.quantize_queries(frame(spark, q), "id", "v")
    want = sorted((i, r + 1, int(j), float(score[i, j])) for i in range(5) for r, j in enumerate(np.lexsort((np.arange(57), -score[i]))[:3]))
    for strategy in ("native", "blocked"):
        for parts in (1, 5):
            index.rows = index.rows.repartition(parts)
            assert sorted(tuple(r) for r in index.search(queries, 3, strategy).collect()) == want


def test_zero_ties_and_padding(spark):
    rows = build_index(frame(spark, [[0.5, 0.5], [0, 0], [0, 0], [0.5, 0.5]]), "id", "v")
    q = rows.where("id = 0").withColumnRenamed("id", "qid")
    got = search.padded(search.search(rows, q, 6), q, 6).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 3, 1, 2, -1, -1]
    assert got[2]["score"] == 0.0 and got[5]["score"] == float("-inf")
    with pytest.raises(ValueError):
        search.search(rows, q, 0)


def test_rounding_modes_differ_on_ties(spark):
    df = spark.createDataFrame([(0, [127.0, 0.5, 2.5, -2.5])], "id long, v array<float>")
    assert build_index(df, "id", "v").first()["codes"] == [127, 1, 3, -3]
    assert build_index(df, "id", "v", "even").first()["codes"] == [127, 0, 2, -2]


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None], [1.0, float("nan")], [float("inf"), 0.0]])
def test_invalid_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(0, bad)], "id long, v array<float>")
    with pytest.raises(Exception, match="invalid vector"):
        build_index(df, "id", "v", dim=2).collect()


def test_collapse_ignores_keys_of_dropped_rows(spark):
    rows = [(0, 1, 1, "u1", "t1"), (0, 2, 2, "u2", "t1"), (0, 3, 3, "u2", "t2"), (0, 4, 4, "u1", "t9")]
    df = spark.createDataFrame(rows, "qid long, rank long, id long, url string, text string")
    assert [r["id"] for r in search.collapse(df, 10).orderBy("shown").collect()] == [1, 3]


def test_interleave_and_recall(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], "source string, ord long")
    got = [(r["source"], r["ord"]) for r in ranking.interleave(df, "source", "ord").orderBy("global_id").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2)]
    a = spark.createDataFrame([(0, 1), (0, 2)], "qid long, id long")
    b = spark.createDataFrame([(0, 2), (0, 3)], "qid long, id long")
    assert metrics.recall(a, b, 2).first()[0] == 0.5


def test_mean_pool(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "s array<array<float>>, m array<int>")
    assert df.select(V.mean_pool(F.col("s"), F.col("m"))).first()[0] == [2.0, 3.0]


@pytest.mark.parametrize("parts", [None, 13])
def test_prefix_sums_with_a_payload(spark, parts):
    """Ten thousand rows, whole texts carried along, against DuckDB."""
    import duckdb

    path = "/root/testdata/sf0.1/documents.parquet"
    df = spark.read.parquet(path)
    df = df.repartition(parts) if parts else df
    got = ranking.byte_offsets(ranking.interleave(df, "source", "doc_id"), "doc_id", "text").select("doc_id", "global_id", "offset_start", "offset_end", F.length("text"))
    want = duckdb.sql(f"""SELECT doc_id, row_number() OVER (ORDER BY rn, source) - 1, CAST(sum(strlen(text)) OVER o - strlen(text) AS BIGINT), CAST(sum(strlen(text)) OVER o AS BIGINT), length(text)
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn FROM '{path}') WINDOW o AS (ORDER BY doc_id)""").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_prefix_sums_edges(spark):
    df = spark.createDataFrame([(None, 1, None), ("b", 2, "xé"), ("a", 3, "y"), (None, 4, "z")], "source string, ord long, text string")
    assert [r["ord"] for r in ranking.interleave(df, "source", "ord").orderBy("global_id").collect()] == [1, 3, 2, 4]
    offsets = ranking.byte_offsets(df, "ord", "text")
    assert [(r["offset_start"], r["offset_end"]) for r in offsets.orderBy("ord").collect()] == [(0, 0), (0, 3), (3, 4), (4, 5)]
    assert [r["offset"] for r in ranking.offset_entries(offsets).orderBy("entry").collect()] == [0, 0, 3, 4, 5]
    empty = df.limit(0)
    assert ranking.interleave(empty, "source", "ord").count() == 0 and [tuple(r) for r in ranking.offset_entries(ranking.byte_offsets(empty, "ord", "text")).collect()] == [(0, 0)]
    with pytest.raises(ValueError, match="offset_start"):
        ranking.byte_offsets(offsets, "ord", "text")


def test_exact_search_breaks_ties_by_id(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(30, 33)), 40, axis=0)  # every vector forty times
    rows = frame(spark, x).repartition(3)
    q = rows.where("id % 200 = 0").withColumnRenamed("id", "qid")
    want = [(i, n + 1, int(j)) for i in range(0, 1200, 200) for n, j in enumerate(sorted(range(1200), key=lambda j: (-round(float(x[i] @ x[j]), 9), j))[:50])]
    for group in (2048, 2):
        monkeypatch.setattr(search, "GROUP", group)
        assert sorted(tuple(h)[:3] for h in search.search_exact(rows, q, 50).collect()) == want
    assert search.search_exact(rows.limit(0), q, 5).count() == search.search_exact(rows, q.limit(0), 5).count() == 0


def test_search_requests(spark):
    assert [search.clamped(k) for k in (-3, 0, 7, 1000)] == [1, 1, 7, 100] and search.fetch_depth(100) == 400
    assert search.check_query(" x ") == " x "
    for bad in ("", " \n", "x" * 513, None):
        with pytest.raises(ValueError):
            search.check_query(bad)
    df = spark.createDataFrame([("a",), ("  ",), ("x" * 513,), (None,)], "q string")
    assert [r[0] for r in df.select(search.query_faults(F.col("q"))).collect()] == [None, "empty", "too long", "empty"]
    index = VectorIndex.from_floats(frame(spark, np.eye(4) + 0.1), "id", "v", 4)
    q = index.quantize_queries(frame(spark, np.eye(4)[:2]), "id", "v")
    passages = spark.createDataFrame([(0, "u", "a"), (1, "u", "b"), (2, "", "c"), (3, "", "c")], "id long, url string, text string")
    got = sorted((r["qid"], r["shown"], r["id"], r["text"]) for r in index.search_passages(q, passages, 3).collect())
    assert got == [(0, 1, 0, "a"), (0, 2, 2, "c"), (1, 1, 1, "b"), (1, 2, 2, "c")]
    with pytest.raises(ValueError, match="at most"):
        index.search(q, 401)
    a = search.search(index.rows, q, 4)
    o = {r["qid"]: tuple(r)[1:] for r in search.shown_overlap(a, a.where("rank <= 2 and qid = 0"), passages, 3).collect()}
    assert o == {0: (2, 1, 0.5, 0.5), 1: (2, 0, 0.0, 0.0)}
    none = search.shown_overlap(a, a, passages.limit(0), 3).first()
    assert none["n_shown"] == 0 and none["same_results"] is None and none["same_at_depth"] == 1.0


def test_reports_on_small_rows(spark, tmp_path):
    one = [("sdot", 1, 100, 16, 50, 2.0), ("sdot", 2, 100, 16, 50, 1.0), ("sdot", 1, 200, 16, 50, 4.0)]
    got = {(r["block"], r["n"]): (r["qps"], r["speedup"]) for r in metrics.roofline(spark.createDataFrame(one, "kernel string, block int, n int, dpad int, nq int, seconds double")).collect()}
    assert got == {(1, 100): (25.0, 1.0), (2, 100): (50.0, 2.0), (1, 200): (12.5, 1.0)}
    good = [("q", 120, 2, 3, "t", "T", "http://u", "web", 2.0, 0.9)]
    schema = "query string, n int, sources int, returned int, text string, title string, url string, source string, speedup double, same_results double"
    assert metrics.smoke(spark.createDataFrame(good, schema)).count() == 0
    bad = [("q", 20, 1, 3, "t", "", "ftp", "web", 1.0, 0.5), ("r", 20, 1, 0, None, None, None, None, None, None), ("s", 20, 1, 1, "t", "T", "http", "w", None, None)]
    faults = {r["fault"]: r["faults"] for r in metrics.smoke(spark.createDataFrame(bad, schema)).collect()}
    assert faults == {"index too small": 3, "too few sources": 3, "field missing": 1, "bad url": 1, "indexes disagree": 1, "no results": 1, "nothing to compare": 1, "mean speedup too low": 1}
    v = V.synthetic(spark, 500, 24, seed=3)
    assert sorted(map(tuple, v.collect()))[:3] == sorted(map(tuple, V.synthetic(spark, 500, 24, seed=3).repartition(3).collect()))[:3]
    x = np.array([r["v"] for r in v.collect()])
    assert np.allclose((x * x).sum(1), 1, atol=1e-5) and abs(x.mean()) < 0.01 and metrics.anisotropy(v) < 2
    metrics.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first()["b"] == "x"
    assert spark.range(1).select(V.pq_bytes(F.lit(96)), V.float_bytes(F.lit(384))).first()[:] == (48.0, 1536)
    assert [r[0] for r in spark.createDataFrame([(50.0,), (200.0,), (900.0,)], "ms double").select(metrics.playback(F.col("ms"))).collect()] == ["watchable", "interactive", "slow"]
    use = spark.createDataFrame([(0.96, 2.0, 1.0), (0.9, 2.0, 1.0), (0.96, 1.0, 1.0)], "a double, r double, b double")
    assert [r[0] for r in use.select(metrics.usable(F.col("a"), F.col("r"), F.col("b"))).collect()] == [True, False, False]
