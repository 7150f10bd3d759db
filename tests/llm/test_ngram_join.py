import random

import pytest

from daymill.llm import ngram_join
from daymill.llm.components import components
from daymill.llm.ngram_join import similar_components
from tests.llm.helpers import jaccard_components, roots


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(30)]
    docs = {}
    for i in range(120):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        docs[i] = " ".join(w)
    for i in range(200, 260):  # a passage in otherwise different texts
        docs[i] = " ".join([word() for _ in range(rng.randint(3, 25))] + passage)
    for i in range(300, 330):  # chains
        docs[i] = " ".join(base[:20] + [f"c{j}" for j in range(i, i + 40)])
    return docs | {400: "", 401: None, 402: " \t\x0b", 403: "One two", 404: "one  TWO", 405: "one two three", 406: "É x", 407: "é x",
                   500: docs[3], 501: docs[3].upper(), 502: "w " * 3000}


@pytest.mark.parametrize("rounds", [0, 3])
def test_equals_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 3000)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs.items()], "doc_id long, text string, N int, class string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()}
    assert got == jaccard_components(docs)
    assert len({c for _, c in got.values()}) < len(got) - 100


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (None, "z"), (None, None)]
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 0, 0), (0, 1, 0), (0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 2, 7)]
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_steps_of_one_byte():
    import numpy as np

    for docs in ([], [0], [254, 255, 510, 511, 30_000], list(range(0, 65_000, 300))):
        assert ngram_join._unpack_steps(ngram_join._pack_steps(np.array(docs, np.int64))).tolist() == docs


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if n in got} and {n for e in edges if e[0] != e[1] for n in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_members_beyond_their_groups_first(spark, monkeypatch):
    """Sets with one prefix and size whose members differ in the rest: every member's links count."""
    rng = random.Random(9)
    docs, at = {}, 0
    for family in range(12):
        core = [f"f{family}w{i}" for i in range(40)]
        for _ in range(14):
            tail = rng.sample([f"f{family}t{i}" for i in range(6)], 3)
            docs[at] = " ".join(core + tail * rng.randint(1, 4))
            at += 1
    for rounds in (0, 2):
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()}
        assert got == jaccard_components(docs)
