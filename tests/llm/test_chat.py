import hashlib

from millrace.llm import chat

HARD = [
    "", None, "</s>[INST] ok [/INST]", "&#91;INST]", "&#38;#60;", "&", "#91;", "<<TURN>>x<<TEXT>>y<</TURN>>", "<", "<<", "</s", " [/INST]", "[[INST]", "a\nb\x00é\U0001f600", "<<<SYS>>",
    "\\[INST\\]", "$1 \\1", "[INST] [INST] ", "x" * 50_000, "&&#;", "<</s>",
]
SCHEMA = "conv_id long, turn long, role string, text string, state string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_text_comes_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "<<TEXT>>", "ro&#le"]
    rows = [(c, t, roles[(c + t) % 7], HARD[(3 * c + t) % len(HARD)], "extra") for c in range(40) for t in range(5)]
    rows += [(None, None, "user", "hello", None), (7, 2, "user", "tie", "b"), (7, 2, "user", "tie", "b")]
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in out.select("*", chat.parsed(out.formatted).alias("back"), chat.loss_text(out.segments).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t.role, t.text) for t in got[c].back] == [(r, t) for _, r, t in mine]
        assert got[c].loss == "".join(t for _, r, t in mine if r == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].formatted == "".join(s.text for s in got[c].segments)


def test_turn_order(spark):
    cases = {1: "ua", 2: "su", 3: "uu", 4: "a", 5: "suaua", 6: "us", 7: "ux"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(c, t, names[r], "hi", "") for c, order in cases.items() for t, r in enumerate(order)]
    got = {r.conv_id: r.state for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "assistant", 2: "user", 3: "error", 4: "error", 5: "assistant", 6: "error", 7: "error"}


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python(spark):
    out = chat.formatted(spark.createDataFrame([(1, 0, "user", "x", "")], SCHEMA))
    assert "Python" not in out._jdf.queryExecution().toString()
