import os

import pytest
from pyspark.sql import functions as F

from daymill.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).where(langid.held_out("doc_id"))
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1


def test_answers_without_text_or_labels(spark):
    rows = [(1, "the cat and the dog", "en"), (2, None, "en"), (3, "12 34 !", "en"), (4, "", None), (5, "the dog and a cat", "en"), (5, "the dog and a cat", "en"), (None, "x" * 2_100_000, None)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, Score int")
    got = langid.identify(df)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got.collect()) == [
        (0, "en", 1.0), (1, "en", 1.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (5, "en", 1.0), (5, "en", 1.0)]
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0)).count() == 0


def test_long_texts_are_read_whole():
    import numpy as np

    a, b = langid.features("ab " * 400_000 + "ba " * 400_000), langid.features("ba " * 800_000)
    assert a @ b < 0.95 and np.isclose(a @ a, 1) and langid.features("1 2") is None


def test_families_of_close_languages():
    import numpy as np

    assert langid.families(np.array([[1, 0.1, 0], [0, 0.1, 1], [0.9, 0.2, 0], [0, 0.2, 0.9]])) == [[0, 2], [1, 3]]


def test_machine_separates():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 5)) + 0.0
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    assert ((x @ langid.support_vectors(x, y) > 0) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("key, texts", [(None, 6000), (5, 6000), (5, 1)])
def test_rows_of_one_id_are_learned_from(spark, key, texts):
    rows = [(key, f"the cat and the dog number {w}{i % texts}" if texts > 1 else "the cat and the dog", "en") for i, w in enumerate(["aa", "bb", "cc"] * 2000)]
    rows += [(i, f"der hund und die katze {i}", "de") for i in range(60)]
    df = spark.createDataFrame(rows, "key long, text string, lang string").repartition(4)
    assert langid.train(df).languages == ["de", "en"]
    got = langid.predict(df.where("lang = 'en'"), langid.train(df))
    assert {r.lang_pred for r in got.select("lang_pred").distinct().collect()} == {"en"}
