import random
import re

import pytest
from pyspark.sql import functions as F

from daymill.llm import fingerprints as fp


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.f for r in df.select("i", fp.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]


def test_equal_texts_and_only_they_share_a_root(spark):
    texts = ["", None, "a", "a\n", "a\n\nb", "a\nb", "a. b", "a.b", "a\n\n\nb", "x" * 200_000, "\n\n", "A. B.\nC. D.\n\nE."]
    got = prints(spark, texts + texts)
    assert got[:len(texts)] == got[len(texts):]
    assert got[0] == got[1] and len({g[:32] for g in got}) == len(texts) - 1


def test_likeness_and_edits(spark):
    a = "One two. Three four.\nFive six. Seven.\n\nEight nine. Ten."
    b = "One two. Three four.\nFive six. Seven!\n\nEight nine. Ten."
    pa, pb, pc = prints(spark, [a, b, "Nothing alike."])
    df = spark.createDataFrame([(pa, pb, pc)], "a string, b string, c string")
    r = df.select(fp.likeness(F.col("a"), F.col("a")).alias("aa"), fp.likeness(F.col("a"), F.col("b")).alias("ab"), fp.likeness(F.col("a"), F.col("c")).alias("ac"),
                  fp.differing_paragraphs(F.col("a"), F.col("b")).alias("d"), fp.differing_paragraphs(F.col("a"), F.col("a")).alias("none")).first()
    assert r.aa == 1.0 and 0.6 < r.ab < 1.0 and r.ac == 0.0
    assert r.d == [1] and r.none == []


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_next_over_any_number_of_buckets(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", rows)
    ids = [9, 3, 77, 12, 5, 100, 41, 8, 8, None, 60, 61, 62]
    docs = spark.createDataFrame([(i, f"t{n}", n) for n, i in enumerate(ids)], "doc_id long, text string, bucket int")
    got = {r.text: r.next_text for r in fp.with_next(docs, "doc_id", "text").collect()}
    order = sorted(range(len(ids)), key=lambda n: (ids[n] is None, ids[n] or 0, f"t{n}"))
    assert got == {f"t{a}": f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_next_of_few_rows(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert fp.with_next(one, "doc_id", "text").first().next_text == "a"
    assert fp.with_next(one.limit(0), "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert {(r.text, r.next_text) for r in fp.with_next(nulls, "doc_id", "text").collect()} == {("a", "b"), ("b", "a")}


def test_unpunctuated_and_full_width_texts_have_several_leaves(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghilmnoprstuwy", k=rng.randint(2, 8))) for _ in range(400)]
    plain, wide = " ".join(words), "".join(chr(0x4E00 + n) * (2 + n % 5) + "\u3002\uff01\uff1f"[n % 3] for n in range(60))
    for text in (plain, wide, "x" * 50_000, "no mark at all"):
        half = text[:len(text) * 3 // 4]
        a, b = prints(spark, [text, half])
        r = spark.createDataFrame([(a, b)], "a string, b string").select(fp.likeness(F.col("a"), F.col("b")).alias("n")).first()
        assert (r.n > 0.7) == (text in (plain, wide))
        leaves = re.findall(" [0-9a-f]{8}([0-9a-f]+)", a)
        assert sum(int(n, 16) for n in leaves) == len(text)


def test_an_own_column_gives_way_to_the_result(spark):
    docs = spark.createDataFrame([(1, "a", "mine"), (2, "b", "mine")], "doc_id long, text string, Next_Text string")
    out = fp.with_next(docs, "doc_id", "text")
    assert out.columns == ["doc_id", "text", "next_text"] and {r.next_text for r in out.collect()} == {"a", "b"}
