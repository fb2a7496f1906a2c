import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing, registry


def water(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight; whoever is above its limit gets it, and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 4), max_size=5), st.integers(0, 60))
def test_fit_is_nearest(counts, budget):
    sizes, n = np.array(sorted(counts), np.int64), np.array([counts[k] for k in sorted(counts)], np.int64)
    take = mixing.fit(sizes, n, budget)
    assert ((take >= 0) & (take <= n)).all()
    sums = {sum(a * b for a, b in zip(x, sizes, strict=True)) for x in itertools.product(*(range(k + 1) for k in n))}
    if int((sizes * n).sum()) > budget:
        assert abs(int((take * sizes).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_large_fit_is_exact():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(5, 20_000, 4000))
    n = rng.integers(1, 9, len(sizes))
    total = int((sizes * n).sum())
    for part in (0.01, 0.37, 0.99):
        assert int((mixing.fit(sizes, n, int(total * part)) * sizes).sum()) == int(total * part)


def test_targets_match_repeated_sharing(spark):
    for sizes in ({"a": 100, "b": 5, "c": 900, "d": 40, None: 7}, {"x": 3}, {"a": 0, "b": 10}, {"é": 50, "z": 50, "A": 1, "": 20}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(water(sizes))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), "big" if k % 3 == 0 else f"s{k % 7}", 9) for k in range(600)]
    rows += [(600, None, "big", 1), (601, "", None, 1), (602, "a \t\x0bb\x00c", None, 1), (602, "a \t\x0bb\x00c", None, 1), (None, "x y", "s1", 1)]
    rows += [(700 + k, "same size text", "copies", 1) for k in range(300)]
    path = tmp_path_factory.mktemp("mix")
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_query(spark, folder):
    path, rows = folder
    got = registry.op9_mix(spark, path).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    aims, taken = water(sizes), dict.fromkeys(sizes, 0)
    by_id = {}
    for d, _, s, _ in rows:
        by_id[d] = s
    for r in got:
        taken[by_id[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(aims[by_id[r.doc_id]])
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= 3
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, registry.op9_mix(spark, path).collect()))


def test_taken_repeats_rows_and_empty_table(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "7 AS quota", "'t' AS salt", "8 AS copies", "9 AS whole")
    out = mixing.taken(docs)
    assert out.columns == docs.columns
    n = out.groupBy("doc_id", "text").count().agg({"count": "max"}).first()[0]
    assert 2 <= n <= 4
    assert {(r.quota, r.salt, r.copies, r.whole) for r in out.collect()} == {(7, "t", 8, 9)}
    assert mixing.taken(docs.limit(0)).count() == 0
