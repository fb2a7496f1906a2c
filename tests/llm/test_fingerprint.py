import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import fingerprint, registry


def jaccard(a, b):
    words = lambda t: Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "") or [""])
    x, y = words(a), words(b)
    return sum((x & y).values()) / sum((x | y).values())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{int(k)}" for k in rng.zipf(1.3, int(rng.integers(1, 150))) % 400)
    rows = [(3 * k, text(), "x") for k in range(150)]
    rows += [(1000, None, None), (1001, "", "y"), (1002, " \n\t", "y"), (1003, "é\U0001f600ß" * 7, "y"), (1004, "word " * 9000, "y"), (1005, "b", "y"), (1005, "a", "y"), (1005, "a", "y"), (1006, "twin text", ""), (9_000_000_000, "twin text", "")]
    path = tmp_path_factory.mktemp("fp")
    spark.createDataFrame(rows, "doc_id long, text string, variant string").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


@pytest.mark.parametrize("chars", [fingerprint.BUCKET_CHARS, 2_000])
def test_query(spark, folder, chars, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", chars)
    path, rows = folder
    texts = [(d, t or "") for d, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
    got = sorted(registry.op6_fingerprints(spark, path).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(texts)
    want = []
    for k, (d, t) in enumerate(texts):
        nxt, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, nxt)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(w[:3] for w in want)
    by_id = {w[0]: w for w in want}
    errors = [x for r in got if r.doc_id != 1005 for x in (r.near_edited - by_id[r.doc_id][3], r.near_next - by_id[r.doc_id][4])]
    # the functions are shared, so the errors of different documents go together
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.12
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1006] == prints[9_000_000_000] and prints[1000] == prints[1001] == prints[1002]
    assert len(prints[0]) == 8 * fingerprint.SAMPLES


def test_likeness_tends_to_weighted_jaccard(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{int(k)}" for k in rng.zipf(1.2, 80) % 120) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sig = {r.doc_id: np.array(r.signature) for r in fingerprint.fingerprints(docs, ["doc_id"], samples=160).collect()}
    errors = [(sig[a] == sig[b]).mean() - jaccard(texts[a], texts[b]) for a in range(24) for b in range(a)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and abs(np.mean(errors)) < 0.04


def test_null_ids_one_row_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    assert got[5].next_signature == got[None].signature and got[None].next_signature == got[5].signature
    one = fingerprint.with_edits(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].next_signature == one[0].signature
    assert fingerprint.with_edits(docs.limit(0)).count() == 0


def test_draws_are_gamma_and_uniform(spark):
    from pyspark.sql import functions as F

    r, ln_c, b = fingerprint.draws(F.xxhash64("id"))
    x = spark.range(40_000).select(r.alias("r"), F.exp(ln_c).alias("c"), b.alias("b")).toPandas()
    for name in "rc":
        assert abs(x[name].mean() - 2) < 0.05 and abs(x[name].var() - 2) < 0.15
    assert abs(x.b.mean() - 0.5) < 0.01 and abs(x.b.var() - 1 / 12) < 0.01
    assert np.abs(x.corr().to_numpy() - np.eye(3)).max() < 0.03


def test_one_outlying_id_and_equal_ids_do_not_fill_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", 20_000)
    rows = [(k, f"text {k} " * 10) for k in range(1000)] + [(4 * 10**18, "far away")] + [(5_000, f"{k * 7919 % 1000:03d} of one id") for k in range(1000)]
    placed, buckets = fingerprint.neighbour_buckets(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in placed.where("helper = 0").groupBy("bucket").count().collect()]
    assert buckets > 8 and sum(sizes) == 2001 and max(sizes) < 600


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in fingerprint.with_edits(docs)._jdf.queryExecution().toString()
