import numpy as np
import pytest

from millrace.llm import ann, registry


def brute(ids, x, k=5):
    """query -> the k nearest (id, score), ties to the smaller id"""
    out = {}
    for j in np.flatnonzero(ids % 50 == 0):
        score = ann.cosine(x, np.broadcast_to(x[j], x.shape))
        others = np.array([r for r in range(len(ids)) if r != j])
        order = others[np.lexsort((ids[others], -score[others]))][:k]
        out[int(ids[j])] = [(int(ids[r]), float(score[r])) for r in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    want = brute(rows.vec_id.to_numpy(), np.array(rows.embedding.tolist()).astype(float))
    got = {}
    for r in registry.op7_nearest(spark, folder).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for q, found in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        scores = [got[q][k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
        hits += len({i for i, _ in found} & {got[q][k][0] for k in got[q]})
    assert hits / (5 * len(want)) >= 0.95


def test_recall_over_many_lists(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)  # 30 lists
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(rows) // ann.ROWS_IN_LIST == 30
    got = {}
    for r in registry.op7_nearest(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(len(x)), x.astype(float))
    assert set(got) == set(want)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) for q in want]) / 5 >= 0.95


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_IN_LIST", 20)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    rows = [(int(k), x[k].tolist()) for k in range(200)]
    same = [1.0, 2.0, 0.0, -1.0, 0.5, 3.0]
    rows += [(int(k), same) for k in range(200, 420)] + [(1000, [2 * v for v in same])]
    bad = [(2000, None), (2050, [0.0] * 6), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2150, [float("nan")] * 6), (2200, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (2250, [1.0]), (2300, []), (None, same)]
    spark.createDataFrame([(d, v, 1) for d, v in rows + bad], "vec_id long, embedding array<float>, list int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in registry.op7_nearest(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, v = np.array([d for d, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    want = brute(ids, v)
    assert set(got) == set(want)
    hot = [i for i in want if 200 <= i < 420]
    for q in hot:
        assert [(i, s) for _, i, s in sorted(got[q])] == want[q]
    assert np.mean([len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) >= 4.5


def test_few_and_none(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(frame, frame.vec_id % 50 == 0).collect())
    assert got == [(50, 1, 1), (50, 2, 100), (100, 1, 1), (100, 2, 50)]
    assert ann.nearest(frame.limit(0), frame.vec_id % 50 == 0).count() == 0


def test_more_than_256_lists_and_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_IN_LIST", 20)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6_000, 24)).astype(np.float32)  # 300 lists without structure
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    want = brute(np.arange(len(x)), x.astype(float))
    for within, least in ((ann.WITHIN, 0.93), (1.0, 1.0)):
        got = {}
        for r in ann.nearest(frame, frame.vec_id % 50 == 0, within=within).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert set(got) == set(want)
        assert np.mean([len(got[q] & {i for i, _ in want[q]}) for q in want]) / 5 >= least


def test_cosine_of_very_large_and_small_components():
    x = np.array([[1e200, 1e200], [1e-200, 0.0], [1e-200, 1e200], [3.0, 4.0], [1e300, -1e300]])
    y = np.array([[1e200, 0.0], [1e-300, 1e-300], [1.0, 1.0], [4.0, 3.0], [5e-324, 0.0]])
    assert ann.cosine(x, y) == pytest.approx([0.5**0.5, 0.5**0.5, 0.5**0.5, 0.96, 0.5**0.5])
