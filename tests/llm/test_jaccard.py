import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import common, jaccard, registry


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """component of each row by comparing every pair"""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        low[r] = min(low.get(r, 1 << 62), d)
    return sorted((d, len(sets[k]), low[find(k)]) for k, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.zipf(1.4)) % 300}"
    hot = [word() for _ in range(12)]
    rows, texts = [], []
    for k in range(n):
        if texts and rng.random() < 0.6:
            words = list(texts[int(rng.integers(len(texts)))])
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = word()
        else:
            words = [word() for _ in range(int(rng.integers(1, 90)))]
        if rng.random() < 0.3:
            words = words[: len(words) // 2] + hot + words[len(words) // 2 :]
        texts.append(words)
        rows.append((1000 - k, " ".join(words)))
    return rows


EDGES = [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "A b"), (2004, "a B"), (2005, "a b c d e"), (2006, "A\tb\x0bc d e"), (2007, "long " * 20_000), (2008, "long " * 30_000), (2009, "x\x00y"), (2003, "A b")]


@pytest.mark.parametrize("chunk", [jaccard.CHUNK_SIGNATURES, 300])
def test_against_brute_force(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_SIGNATURES", chunk)
    rows = corpus(7, 260) + EDGES
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in registry.op4_jaccard(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_null_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None), (6, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.component_ids(docs).collect())
    assert got == [("5", 2, None), ("6", 1, 6), ("None", 0, None), ("None", 2, None)]
    assert jaccard.component_ids(docs.limit(0)).count() == 0


@pytest.mark.parametrize("with_common", [False, True])
def test_similar_sets_share_a_signature(with_common):
    scheme, rng = jaccard.Scheme(Fraction(4, 5)), np.random.default_rng(9)
    frequent = common.seeds(900, 40)
    sets = []
    for _ in range(400):
        a = np.unique(np.concatenate([rng.integers(1, 1 << 62, int(rng.integers(1, 60))).astype(np.uint64), frequent[: int(rng.integers(0, 30))]]))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, len(a) // 5)))):
            move = rng.random()
            b = np.delete(b, int(rng.integers(len(b)))) if move < 0.5 and len(b) > 1 else np.append(b, rng.integers(1, 1 << 62, 1).astype(np.uint64))
        sets += [a, np.unique(b)]
    sizes = np.array([len(s) for s in sets])
    rows, values, tags = scheme.sign(sizes, np.concatenate(sets), np.sort(frequent) if with_common else None)
    held = [{t: set(values[(rows == k) & (tags == t)].tolist()) for t in set(tags[rows == k].tolist())} for k in range(len(sets))]
    similar = 0
    for a, b in zip(range(0, len(sets), 2), range(1, len(sets), 2), strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and both != len(sets[a]) + len(sets[b]) - both:
            similar += 1
            # they meet in some kind of signature as often as the one set's tag says, and the other's
            meets = [(x, y) for x in held[a] for y in held[b] if len(held[a][x] & held[b][y]) >= max(x // 8, y // 8)]
            assert meets
    assert similar > 80


def test_shingle_hashes_follow_the_definition():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Ab", "aB", "c", "dé", "É"], int(rng.integers(0, 12)))) for _ in range(200)] + [None, "", "\n x\r"]
    seen = {}
    for row, found in common.text_shingles(pa.array(texts)):
        want = shingles(texts[row])
        assert len(found) == len(want)
        assert seen.setdefault(frozenset(want), found.tobytes()) == found.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(1, 1 << 62, int(rng.integers(0, 200))).astype(np.uint64)]))
        if len(b):
            low, true = jaccard.least_difference(jaccard.parity_sketch(a), jaccard.parity_sketch(b)), len(np.setxor1d(a, b))
            assert low <= true


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 150), (777, 777), (300, 301), (301, 300)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 51)) and got[200] == got[150] == 100 and got[301] == 300 and 777 not in got
