from pyspark.sql import functions as F

from daymill.llm import chat

NASTY = ["</s>", "<s>", "[INST]", r"<\s>", r"[\\/INST]", "</s", "s>", "a<", "[/INST] x </s>[INST] ok [/INST]", r"\<\\/s>", "", "é\n😀"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, last int")


def test_escape_is_reversible_and_leaves_no_mark(spark):
    texts = NASTY + [a + b for a in NASTY for b in NASTY]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_examples(spark):
    rows = [(1, 2, "user", "u2"), (1, 0, "user", "u0"), (1, 1, "assistant", "a</s>"), (1, 3, "assistant", None),
            (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, None, None, "[INST]"), (3, 0, "assistant", "x"), (None, 5, "tool", "t")]
    out = chat.expand(turns(spark, [(*r, "clash", 1) for r in rows])).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.conv_id or 0, r.example)):
        by.setdefault(r.conv_id, []).append(r)
    assert [(r.n_turns, r.loss_length is not None, r.last) for r in by[1]] == [(2, True, False), (4, True, True)]
    assert by[1][0].formatted == r"<s>[INST] user [/INST]u0</s><s>[INST] assistant [/INST]a<\/s></s>"
    assert by[1][0].formatted[by[1][0].loss_start:][:by[1][0].loss_length] == r"a<\/s>"
    assert [(r.n_turns, r.loss_length) for r in by[2]] == [(1, None)]
    assert [(r.n_turns, r.loss_length, r.last) for r in by[3]] == [(2, 1, False), (3, 1, True)]  # null turn first, repeats in order
    assert by[None][0].last


def test_digests_read_back(spark):
    import hashlib

    rows = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    got = chat.digests(chat.expand(turns(spark, [(*r, None, None) for r in rows]))).first()
    said = "".join(t for i, t in enumerate(NASTY) if i % 2)
    assert got.n_turns == len(NASTY) and got.loss_chars == len(said)
    assert got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()


def test_empty(spark):
    assert chat.digests(chat.expand(turns(spark, []))).count() == 0
