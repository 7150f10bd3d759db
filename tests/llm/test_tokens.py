"""BPE and token counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daymill.llm import bpe, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=300):
    rng = random.Random(3)
    signs = "aaabceè \t\n\x1c\x85　 \xa0漢字😀𝔘123's're!!--__<|endoftext|>İΣσςǅẞﬁé"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts + ["", None, "a" * 3000, "=-" * 900, "x y " * 40_000, "zqxj " * 700, "a<|endoftext|> b<|startoftext|>", "ΑΣ ΑΣ", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", i % 3) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, decoded int").repartition(3)


def test_codec_equals_library(docs):
    coded = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]  # clashing columns give way
    got = {r.doc_id: r for r in coded.collect()}
    want = Tokenizer.from_file(BYTES)
    for i, e in enumerate(want.encode_batch([t or "" for t in odd_texts()], add_special_tokens=False)):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == e.ids
        assert got[i].n_tokens == len(e.ids)
        assert got[i].decoded == want.decode(e.ids, skip_special_tokens=False)


def test_one_pass_equals_two(docs):
    two = bpe.decode(bpe.encode(docs, BYTES), BYTES).select("doc_id", "ids", "n_tokens", "decoded")
    one = bpe.round_trip(docs, BYTES)
    assert one.columns == two.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_every_entry_encodes_as_itself():
    for path in (BYTES, WORDS):
        v = bpe.Vocabulary(path)
        for r in range(0, len(v.left), 37):
            if v.left[r] >= 0:
                assert v.merge[v.left[r], v.right[r]] == r and v.compatible(v.left[r], v.right[r]) is False


def test_merging_agrees_with_backtracking():
    v, rng = bpe.Vocabulary(BYTES), random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 14)))
        parts = [v.rank[c] for c in word]
        while True:
            best = min(((v.merge[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in v.merge), default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [best[0]]
        whole = v.rank.pop(word, None)  # no short cut
        assert v.ranks(word) == parts
        if whole is not None:
            v.rank[word] = whole


def test_counts_equal_library(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 1 << 15)
    rows = token_counts.count_tokens(docs, WORDS).collect()
    want = Tokenizer.from_file(WORDS).encode_batch([t or "" for t in odd_texts()], add_special_tokens=False)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == [
        (i, len((t or "").encode()), len(e.ids)) for i, (t, e) in enumerate(zip(odd_texts(), want))]


def test_counts_with_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "zqxj zqxj"), (1, "zqxj zqxj"), (None, "a b"), (None, None)], "doc_id long, text string")
    rows = token_counts.count_tokens(docs, WORDS).collect()
    one = len(Tokenizer.from_file(WORDS).encode("zqxj zqxj", add_special_tokens=False).ids)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == [(0, 0, 0), (0, 3, 2), (1, 9, one), (1, 9, one)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, WORDS).count() == 0
    assert bpe.decode(bpe.encode(none, BYTES), BYTES).count() == 0
