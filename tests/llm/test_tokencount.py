import numpy as np

from millrace.llm import registry, tokencount


def test_against_brute_force(spark, tmp_path):
    texts = ["", None, "one two three", "one two three", "x" * 70_000, "\n\n  é\U0001f600", "<|endoftext|>"] + ["word " * k for k in range(0, 3000, 37)]
    spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    encode = tokencount.encoding(registry.BYTE_RANKS, registry.BYTE_PATTERN).encode_ordinary
    n = np.array([len(encode(t or "")) for t in texts])
    hist = registry.op8_token_counts(spark, str(tmp_path))
    got = {r.n_tokens: r for r in hist.collect()}
    assert sorted(got) == sorted(set(n.tolist()))
    for x, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.tokens_within) == ((n == x).sum(), (n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum())
        assert r.share_up_to == (n <= x).mean()
    limits = [0, 1, 5, 1023, 1024, 2048, 10**9]
    for r in tokencount.at_limits(hist, limits).collect():
        assert (r.tokens_within, r.docs_cut, r.tokens_cut) == (np.minimum(n, r.context).sum(), (n > r.context).sum(), np.maximum(n - r.context, 0).sum())
    for r in tokencount.quantiles(hist, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == np.sort(n)[int(np.ceil(r.share * len(n))) - 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string")
    assert tokencount.histogram(tokencount.lengths(docs, registry.BYTE_RANKS, registry.BYTE_PATTERN)).count() == 0
