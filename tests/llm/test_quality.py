import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality, registry


def test_features_by_hand():
    texts = ["ab cd", "", "x", "  ab ", "A" * 10]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    value, rows = quality.features(data, at)
    for k, t in enumerate(texts):
        padded = f" {t} "
        want = len(t.split())
        for n in quality.GRAMS:
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                want += (" " not in gram[1:-1]) if n > 2 else gram.strip() != ""
        assert rows[k + 1] - rows[k] == want, t
    alone, _ = quality.features(np.frombuffer(b"ab cd", np.uint8), np.array([0, 5]))
    assert sorted(value[rows[0] : rows[1]]) == sorted(alone)


def test_held_out_accuracy(spark):
    got = registry.op10_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == 10_000 and (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 0, 0), (2, None, 0), (1, 1, 0), (1, 0, 0), (1, 0, 0)]])
def test_edge_rows(spark, labels):
    rows = [(1, "good words here", 5), (None, None, 1), (2, "", 1), (2, "", 1), (3, "z" * 300_000, 0), (4, " \n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scored(docs, known).collect()
    assert len(got) == len(rows)
    assert len({r.score for r in got if not (r.text or "").strip()}) <= 2
    assert quality.scored(docs.limit(0), known).count() == 0


def test_sums_do_not_depend_on_neighbours():
    table = np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32)
    one = quality.row_sums(pa.array(["some text"]), table)[0]
    assert (quality.row_sums(pa.array(["x y", "some text", None, "some text"]), table)[[1, 3]] == one).all()


def test_the_driver_gives_memory_back_after_training(spark, monkeypatch):
    called = []
    monkeypatch.setattr(quality.common, "give_back", lambda: called.append(1))
    docs = spark.createDataFrame([(k, f"{'good' if k % 2 else 'bad'} text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    table, _ = quality.learned(docs, labels)
    assert called and table.any()
    quality.learned(docs, labels.limit(0))
