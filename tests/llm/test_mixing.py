import hashlib
import random

from pyspark.sql import functions as F

from daymill.llm.mixing import Mix, mix_sources, route, targets, words


def test_targets_stop_at_the_cap_and_share_the_rest():
    got = targets({"a": 100, "b": 1000, None: 400}, Mix())
    assert got["a"] == 200 and abs(sum(got.values()) - 2250) < 1e-6
    assert got["b"] <= 2000 and got[None] <= 800
    assert abs(got["b"] / 1 - got[None] / 2) < 1e-6 or got[None] == 800
    assert targets({}, Mix()) == {}


def test_flow_of_overlapping_sources_is_cheapest():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 50)]
    flow = route(patterns, {"a": 150, "b": 120}, 2)
    assert sum(f.get("a", 0) for f in flow) == 150 and sum(f.get("b", 0) for f in flow) == 120
    taken = [sum(f.values()) for f in flow]
    assert all(t <= 2 * n for t, (_, n) in zip(taken, patterns))
    assert sum(max(0, t - n) for t, (_, n) in zip(taken, patterns)) == 20  # 270 words from 250: 20 repeats, no more
    assert route([(("a",), 10)], {"a": 50}, 2) == [{"a": 20}]


def brute(rows, seed=17):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, out = targets(sizes, Mix()), {}
    for s in sizes:
        quota, at = int(want[s] + 0.5), 0
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])):
            out[d] = (n, sizes[s], want[s], sum(n for lap in (0, 1) if 2 * (lap * sizes[s] + at) + n < 2 * quota))
            at += n
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["s", "s", "s", "Z", "é", None, "zero"]), rng.choice([0, 1, 5, 40, 900])) for i in range(700)]
    rows = [(d, s, 0 if s == "zero" else n) for d, s, n in rows]
    docs = spark.createDataFrame([(*r, "c", [1]) for r in rows], "doc_id long, source string, n long, SIZE string, copies array<int>").repartition(4)
    got = mix_sources(docs, F.array("source"), F.col("n"))
    assert got.columns == ["doc_id", "source", "n", "size", "copies", "source_stats"]
    stat = F.col("source_stats")[0]
    got = {r.doc_id: (r["size"], r.a, r.t, r["size"] * len(r.copies)) for r in got.select("*", stat["source_size"].alias("a"), stat["target"].alias("t")).collect()}
    assert got == brute(rows)
    for s in {"s", "Z", "é", None}:
        mine = [got[d] for d, t, _ in rows if t == s]
        assert abs(sum(m[3] for m in mine) - mine[0][2]) <= 900


def test_overlapping_sources(spark):
    rows = [(i, [["a"], ["a", "b"], ["b", "a", "b"], None, []][i % 5], 10) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n long")
    got = mix_sources(docs, F.col("sources"), F.col("n")).collect()
    assert len(got) == 500
    for r in got:
        assert set(r.copies) <= set(r.sources or [None]) and len(r.copies) <= 2
    want = {s.source: s.target for r in got for s in r.source_stats}
    for s, t in want.items():
        assert abs(sum(10 * r.copies.count(s) for r in got) - t) <= 40


def test_words_nulls_and_empty(spark):
    df = spark.createDataFrame([("a\x0bb  c d",), (None,), ("",), (" \n",)], "text string")
    assert [r[0] for r in df.select(words("text")).collect()] == [4, 0, 0, 0]
    none = spark.createDataFrame([], "doc_id long, source string, n long")
    assert mix_sources(none, F.array("source"), F.col("n")).count() == 0
    twice = spark.createDataFrame([(None, None, 5), (None, None, 5), (1, None, None)], "doc_id long, source string, n long")
    got = [len(r.copies) for r in mix_sources(twice, F.array("source"), F.coalesce("n", F.lit(0))).collect() if r["size"]]
    assert got in ([1, 1], [2, 2])  # equal rows are taken together
