import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymill.llm import packing

ODD = ["", None, "a", "  two   spaces \n\n \t x  ", "<|endoftext|> inside <|endoftext|>", "été 東京 🙂 'll 12 3", "x" * 30_000, "\n \n  \n", "word " * 9000]


def packed(rows, key="doc_id"):
    """Pieces by document and by sequence; checks that each id lies in one piece and offsets have no gap."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r[key], []).append((r.start, bytes(r.ids), r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    return docs, {s: sum(n for _, n in p) for s, p in seqs.items()}


def test_fill_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 7))]
        room = rng.randint(0, 30)
        counts = {n: items.count(n) for n in set(items)}
        got = packing.fill(counts, room)
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


@pytest.mark.parametrize("capacity", [8, 100, 1024])
def test_plan_places_everything(capacity):
    rng = random.Random(capacity)
    for _ in range(12):
        counts = {rng.randint(1, capacity - 1): rng.choice([1, 2, 60, 900]) for _ in range(rng.randint(1, 60))}
        p = packing.plan(counts, capacity)
        length = np.concatenate([np.full(c, n) for n, c in counts.items()]).astype(np.int64)
        rank = np.concatenate([np.arange(c) for c in counts.values()])
        windows, cover = {}, {}
        for parts in packing.place(p, length, rank):
            for i, start, n, window, offset in zip(*parts):
                windows.setdefault(window, []).append((offset, n))
                cover.setdefault(i, []).append((start, n))
        total = int(length.sum())
        assert len(windows) == p.windows == -(-total // capacity)  # one window at most is not full
        for i, parts in cover.items():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert ends[-1] == length[i] and [s for s, _ in sorted(parts)] == [0, *ends[:-1]]
        for parts in windows.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert ends[-1] <= capacity and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]


def test_copies_of_one_length_leave_one_window_open():
    p = packing.plan({700: 10_000}, 1024)
    assert p.windows == -(-7_000_000 // 1024) and len(p.key) < 100


def test_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.token_ids(df, path).collect()}
    assert rows == {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(ODD)}


def test_packs_documents_whole(spark):
    import public_tokenizers

    df = spark.createDataFrame([(i % 40 or None, ODD[i % len(ODD)]) for i in range(120)], "doc_id int, text string").repartition(5)
    tokens = packing.token_ids(df, public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in tokens.collect():
        want.setdefault(r.doc_id, []).append(bytes(r.ids))
    docs, seqs = packed(packing.pack(tokens).collect())
    total = sum(len(x) for v in want.values() for x in v) // 4
    assert sorted(seqs.values())[1:] == [1024] * (len(seqs) - 1) and len(seqs) == -(-total // 1024)
    assert {k: sum(len(b) for _, b, _ in v) for k, v in docs.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    single = {k: v for k, v in want.items() if len(v) == 1}
    for k, v in single.items():
        assert b"".join(b for _, b, _ in sorted(docs[k])) == v[0]
        assert {n for _, _, n in docs[k]} == {len(v[0]) // 4}


def test_copies_nulls_names_and_empty(spark):
    ids = np.arange(5, dtype="<u4").tobytes()
    rows = [(i % 3, bytearray(ids)) for i in range(50)] + [(None, None), (7, bytearray())]
    df = spark.createDataFrame(rows, "length int, ids binary")
    got = packing.pack(df, key="length", capacity=7)
    assert got.columns == ["length", "start", "_length", "ids", "doc_tokens", "sequence_id", "offset"]
    out = got.collect()
    assert sum(r["_length"] for r in out) == 250 and {r["length"] for r in out} == {0, 1, 2}
    assert got.agg(F.count_distinct("sequence_id")).first()[0] == 36
    assert packing.pack(df.limit(0), key="length").count() == 0


def test_query_digests(spark):
    from daymill.llm.catalog import QUERIES
    from tests.llm.helpers import sample_dir

    sf = sample_dir()
    rows = QUERIES["op11_slack_packing"](spark, sf).collect()
    import public_tokenizers

    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in packing.token_ids(
        spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    held = dict.fromkeys(ids, 0)
    ends = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id] += r.length
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert held == {d: len(x) for d, x in ids.items()}
    assert sorted(ends.values())[1:] == [1024] * (len(ends) - 1)
