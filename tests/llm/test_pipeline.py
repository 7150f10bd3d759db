"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from daymill.session import staged
from tests.llm.helpers import WORD, jaccard_components
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import brute as brute_mix

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")


@pytest.fixture(scope="module")
def kept(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF), "stage"))
    return [d.collect() for d in docs]


def test_language_rejects_only_what_it_cannot_name(kept):
    assert {r.doc_id for r in kept[1]} <= {r.doc_id for r in kept[0]} and len(kept[1]) >= 0.98 * len(kept[0])
    assert {(r.doc_id, r.text) for r in kept[1]} <= {(r.doc_id, r.text) for r in kept[0]}


def test_language_keeps_each_document_with_a_letter(spark, kept):
    assert {r.doc_id for r in kept[1]} == {r.doc_id for r in kept[0] if any(c.isalpha() for c in r.text or "")}
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(30)] + [(100 + i, f"le chat et le chien {i}", "fr") for i in range(30)]
    rows += [(200 + i, f"il gatto e il cane {i}", "it") for i in range(30)] + [(300 + i, f"der hund und die katze {i}", "de") for i in range(30)]
    rows += [(900, "Re.", "en"), (901, "q", None), (902, "zz xx", None), (903, "12 !", "en"), (904, None, None), (905, "\u65e5\u672c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r[0] for r in rows} - {903, 904}
    for given in (docs, docs.withColumn("lang", F.lit(None).cast("string"))):
        assert {r.doc_id for r in corpus_pipeline.language_id(spark, given, "").collect()} == want


def test_language_fills_missing_labels_with_the_prediction(spark, monkeypatch):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(30)] + [(100 + i, f"le chat et le chien {i}", "fr") for i in range(30)]
    rows += [(900, "the dog and the cat", None), (901, "le chien et le chat", None), (902, "le chat", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {r[0]: r[2] for r in rows} | {900: "en", 901: "fr"}
    monkeypatch.setattr(corpus_pipeline.langid, "identify", lambda d: d.withColumns({"lang_pred": F.lit("zz"), "score": F.lit(1.0)}))
    assert {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}[900] == "zz"


def test_other_columns_keep_their_values(spark):
    names = ["score", "lang_pred", "size", "copies", "copy", "source_stats", "n_lines", "n_removed", "col", "key", "row", "goes", "_others"]
    base = spark.createDataFrame([(i, f"le chat numero {i} est ici\nligne {i}", "fr", "s", 9) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.withColumns({n: F.lit(i) + F.col("doc_id") for i, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[n] == i + r.doc_id for r in rows for i, n in enumerate(names))
        assert stage(spark, docs.limit(0), "").count() == 0


def test_one_row_of_copies_without_or_with_equal_ids(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (None, text, "d"), (None, "alone in this table " * 3, "e"), (None, None, "f"), (None, None, "f"), (3, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.ngram_groups(spark, docs, "").collect()]
    assert len(got) == 5 and sum(t == text for _, t, _ in got) == 1 and [d for d, t, _ in got if t == text] == [1]
    nulls = spark.createDataFrame([(None, text, "a")] * 4, docs.schema)
    assert [tuple(r) for r in corpus_pipeline.ngram_groups(spark, nulls, "").collect()] == [(None, text, "a")]


def test_lines(kept):
    want = brute_lines({r.doc_id: r.text for r in kept[1]})
    lines = {r.doc_id: r.text.count("\n") + 1 for r in kept[1]}
    assert {r.doc_id: (r.text, r.n_chars) for r in kept[2]} == {d: (t, len(t)) for d, (t, n) in want.items() if n == 0 or n < lines[d]}


def test_groups(kept):
    want = jaccard_components({r.doc_id: r.text for r in kept[2]})
    assert {r.doc_id for r in kept[3]} == {d for d, (_, c) in want.items() if c == d}


def test_mix(kept):
    want = brute_mix([(r.doc_id, r.source, len(WORD.findall(r.text))) for r in kept[3]])
    got = {}
    for r in kept[4]:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert {d: w[3] for d, w in want.items() if w[3]} == {d: n for d, n in got.items() if n}


def test_codec(kept):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
                  for r in kept[4] for ids in [lib.encode(r.text, add_special_tokens=False).ids])
    assert sorted(tuple(r) for r in kept[5]) == want


def test_run_is_the_stages(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[5]))
    assert kept[4] and len(kept[4][0]) == len(kept[0][0])
