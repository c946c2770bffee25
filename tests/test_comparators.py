import numpy as np
import pytest

from vecloom.operators import comparators as C
from vecloom.operators import search as S

DIM, N = 16, 400


@pytest.fixture(scope="module")
def x():
    r = np.random.default_rng(11)
    v = r.normal(size=(8, DIM))[r.integers(8, size=N)] + r.normal(size=(N, DIM)) * 0.4
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark, x):
    bad = [(N, None), (N + 1, [1.0] * 3), (N + 2, [None] * DIM), (N + 3, [float("nan")] * DIM)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "id long, v array<float>").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "id long, v array<float>")


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id % 20 = 0 and id < 400").withColumnRenamed("id", "qid")


def top(scores, ids, k):
    order = np.lexsort((ids, -scores))[:k]
    return list(ids[order]), scores[order]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["id"], r["score"]))
    return out


def recall(got, x, k):
    hits = 0
    for q, rows in got.items():
        hits += len({i for i, _ in rows} & set(top(x.astype(float) @ x[q].astype(float), np.arange(N), k)[0]))
    return hits / (k * len(got))


@pytest.mark.parametrize("per_dim", [True, False])
def test_scalar(vectors, asked, x, per_dim):
    got = by_query(C.search_scalar(C.scalar_index(vectors, DIM, per_dim), asked, 10))
    d = x.astype(float)
    lo, hi = (d.min(0), d.max(0)) if per_dim else (d.min(), d.max())
    step = (hi - lo) / 255
    dec = lo + np.floor((d - lo) / step + 0.5) * step
    for q, rows in got.items():
        ids, scores = top(dec @ d[q], np.arange(N), 10)
        assert [s for _, s in rows] == pytest.approx(list(scores), abs=1e-9)
        assert len(set(ids) & {i for i, _ in rows}) >= 9
    assert len(got) == 20 and recall(got, x, 10) >= 0.95


def test_scalar_constant_dimension(spark, empty):
    same = spark.createDataFrame([(i, [0.5, float(i)]) for i in range(3)], "id long, v array<float>")
    assert [r["v"] for r in C.decoded(C.scalar_index(same, 2)).orderBy("id").collect()] == [[0.5, 0.0], [0.5, pytest.approx(1.0, abs=0.005)], [0.5, 2.0]]
    assert C.scalar_index(empty, 2).count() == C.scalar_index(empty, 2, False).count() == 0


@pytest.mark.parametrize("nlist,nprobe", [(1, None), (6, 6), (6, 2)])
def test_pq(vectors, asked, x, nlist, nprobe, monkeypatch):
    model = C.fit_pq(vectors, DIM, 8, nlist)
    index = C.pq_index(vectors, model)
    rows = {r["id"]: r for r in index.collect()}
    assert sorted(rows) == list(range(N))
    cell, code = model.encode(x.astype(float))
    assert [(rows[i]["cell"], bytes(rows[i]["code"])) for i in range(N)] == [(c, k.tobytes()) for c, k in zip(cell, code)]
    rebuilt = model.cells[cell] + np.concatenate([model.books[j][code[:, j]] for j in range(8)], 1)
    got = by_query(C.search_pq(index, asked, model, 10, nprobe))
    for q, hits in got.items():
        wanted = np.argsort(-(model.cells @ x[q]), kind="stable")[: nprobe or 1]
        at = np.flatnonzero(np.isin(cell, wanted))
        _, scores = top(rebuilt[at] @ x[q].astype(float), at, 10)
        assert [s for _, s in hits] == pytest.approx(list(scores), abs=1e-9)
    assert len(got) == 20 and ((rebuilt - x) ** 2).mean() < 0.25 * x.var()
    monkeypatch.setattr(S, "GROUP", 7)  # groups of queries don't matter
    assert by_query(C.search_pq(index, asked, model, 10, nprobe)) == got


@pytest.mark.parametrize("name", ["vec_pq_topk", "vec_ivf_pq_topk"])
def test_pq_queries_reach_their_recall(spark, name):
    from vecloom.operators import metrics
    from vecloom.plans import catalog

    d = "/root/testdata/sf0.1"
    got, exact = catalog.QUERIES[name](spark, d).cache(), catalog.vec_search_exact_topk(spark, d).cache()
    assert metrics.recall(got, exact, catalog.K).first()["recall"] >= 0.9
    assert got.groupBy("qid").count().where("count <> 10").count() == 0
    assert got.join(exact.select("qid", "id", exact["score"].alias("x")), ["qid", "id"]).where("abs(score - x) > 1e-6").count() == 0


def test_pq_edges(vectors, empty, asked):
    model = C.fit_pq(empty, DIM, 4)
    assert C.search_pq(C.pq_index(empty, model), asked, model, 3).count() == 0
    few = C.fit_pq(vectors.where("id < 3"), DIM, 4, 2)
    assert C.search_pq(C.pq_index(vectors.where("id < 3"), few), asked, few, 10).count() == 60
    assert C.search_pq(C.pq_index(vectors, few), empty.withColumnRenamed("id", "qid"), few, 3).count() == 0
    with pytest.raises(ValueError, match="divide"):
        C.fit_pq(vectors, DIM, 5)
