import hashlib
import re
from collections import Counter

import corpus_pipeline as pipeline
from millrace.llm import linededup, quality, registry
from millrace.llm.common import stored, table
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_linededup import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_every_stage_against_its_definition(spark):
    tokenizers = __import__("tokenizers").Tokenizer.from_file(registry.WORD_BPE)
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {0: docs.collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stored(stage(spark, docs, SF))
        rows[k + 1] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    scores = {r.doc_id: r.predicted for r in quality.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in rows[1]) == sorted(d for d, p in scores.items() if p == 1)
    want = [(d, t) for d, t, n, gone in brute_lines([(r.doc_id, r.text) for r in rows[1]]) if gone == 0 or gone < n]
    assert sorted((str(r.doc_id), r.text) for r in rows[2]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in rows[2])
    groups = brute_components([(r.doc_id, r.text) for r in rows[2]])
    assert sorted(r.doc_id for r in rows[3]) == sorted(d for d, n, c in groups if n == 0 or c == d)
    # the mix: whole documents, whose words come near 150 % of all, none more often than twice
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts, taken = {r.doc_id: r.text for r in rows[3]}, Counter(r.doc_id for r in rows[4])
    assert max(taken.values()) <= 2 and all(texts[r.doc_id] == r.text for r in rows[4])
    total = sum(words(t) for t in texts.values())
    assert abs(sum(words(texts[d]) * n for d, n in taken.items()) - 1.5 * total) <= 20 * 30
    assert Counter(r.doc_id for r in rows[5]) == taken
    for r in rows[5]:
        assert r.ids == tokenizers.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_take_odd_rows(spark):
    passage = "\n".join(f"line number {k} of it" for k in range(9))
    odd = [(1, passage, "en", "a", 1), (2, passage, "en", None, 1), (3, None, None, "a", None), (4, "", "en", "b", 0), (None, "no id here", "en", "b", 9), (5, "q " * 50_000, "de", "b", 1), (5, "q " * 50_000, "de", "b", 1), (6, passage + "\nmore", "en", "a", 2)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    one = pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "3", "4", "5", "None"]
    lines = pipeline.drop_repeated_lines(spark, docs, SF).collect()
    assert len(lines) >= 6 and linededup.LEAST_LINES == 2
    assert pipeline.encode(spark, docs, SF).count() == len(odd)


def test_last_stage_decodes(spark):
    tokenizers = __import__("tokenizers").Tokenizer.from_file(registry.WORD_BPE)
    docs = spark.createDataFrame([(1, "some plain words", "a"), (2, "", "a")], "doc_id long, text string, source string")
    for r in pipeline.encode(spark, docs, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(tokenizers.decode(r.ids).encode()).hexdigest()


def test_each_text_of_an_id_for_itself_and_clashing_columns(spark):
    x, y = " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(40))
    rows = [(1, x), (5, x), (5, y), (9, y), (9, y), (5, y + " more")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t), 0.5, 2, 3, 4, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_lines int, row_ int, text_key string")
    one = pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert one.columns == docs.columns
    got = [(r.doc_id, r.text) for r in one.collect()]
    assert (1, x) in got and len(got) == 2 and got[0][1] != got[1][1] and {d for d, _ in got} == {1, 5}
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all((r.score, r.predicted, r.n_lines, r.row_, r.text_key) == (0.5, 2, 3, 4, "k") for r in out.collect())
