import hashlib

from millrace.llm import linededup


def brute(rows):
    """The definition, in plain Python; rows are (doc_id, text)."""
    chunks = {}
    for doc, text in {(d, t) for d, t in rows if t is not None}:
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        start = 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or (h[i] + linededup.FACTOR * (h[i - 1] if i else 0)) % linededup.DIVISOR == 0:
                chunks[doc, text, start] = lines[start : i + 1]
                start = i + 1
    first, gone = {}, {}
    for (doc, text, start), part in sorted(chunks.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][2])):
        if len(part) > 1 and first.setdefault(tuple(part), (doc, text, start)) != (doc, text, start):
            gone.setdefault((doc, text), set()).update(range(start, start + len(part)))
    return sorted(
        (str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())), 0 if t is None else len(t.split("\n")), len(gone.get((d, t), ()))) for d, t in rows
    )


def test_against_brute_force(spark):
    passage = "\n".join(f"shared line {k}" for k in range(12))
    rows = [(k, f"own {k}\n{'more' * (k % 3)}\n{passage}\ntail {k}\nend") for k in range(30)]
    rows += [(100, None), (101, ""), (102, ""), (103, "\n\n\n"), (104, "\n\n\n"), (None, passage), (105, passage), (105, passage), (106, passage + "\n" + passage), (107, "x\n" * 3000)]
    rows += [(108, "é\nü\nß\r\n"), (109, "é\nü\nß\r\n")]
    docs = spark.createDataFrame([(d, t, 7, "c", "k", 5) for d, t in rows], "doc_id long, text string, n_lines int, removed_ string, key string, removed int")
    out = linededup.deduped(docs)
    assert out.columns == ["doc_id", "text", "removed_", "key", "removed", "n_lines", "removed_lines"]
    assert {(r.removed_, r.key, r.removed) for r in out.collect()} == {("c", "k", 5)}
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.removed_lines) for r in out.collect())
    assert [g[0] for g in got] == [w[0] for w in brute(rows)]
    for g, w in zip(sorted(got, key=str), sorted(brute(rows), key=str), strict=True):
        assert g == w
    # the passage's inner chunks stay once
    assert sum("shared line 5\n" in (g[1] or "") for g in got) <= 3


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"the passage has line {k} here" for k in range(40))
    docs = spark.createDataFrame([(1, "a\n" + passage), (2, "b\nc\nd\n" + passage + "\ne")], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduped(docs).collect()}
    assert got[1].removed_lines == 0 and got[2].removed_lines > 25


def test_empty_table_and_no_python(spark):
    out = linededup.deduped(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
