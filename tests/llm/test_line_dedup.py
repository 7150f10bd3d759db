import hashlib
import random

from daymill.llm.line_dedup import Chunking, remove_repeated_chunks
from tests.llm.helpers import WORD


def brute(docs):
    """Text and removed lines by id, for ids without repeats."""
    def looked_up(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        long = [len(WORD.findall(x)) > 50 for x in lines]
        out, start = [], 0
        for i in range(len(lines)):
            roll = (h[i] + (h[i - 1] * 1_000_003 % (1 << 28) if i else 0)) % (1 << 28)
            if roll % 32 or long[i] or i == len(lines) - 1 or long[i + 1]:
                if i > start or long[i]:
                    out.append((start, i))
                if start:
                    out.append((start - 1, i))
                start = i + 1
        return lines, out

    first, out = {}, {}
    for d, text in sorted(docs.items()):
        lines, places = looked_up(text)
        gone = set()
        for s, e in sorted(places):
            t = "\n".join(lines[s:e + 1])
            if t.strip(" \t\n\x0b\x0c\r"):
                at = first.setdefault(t, (d, s))
                if at != (d, s):
                    gone |= set(range(max(s, at[1] + e - s + 1) if at[0] == d else s, e + 1))
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {i} of the pool" for i in range(40)] + ["", " ", "x" * 5000]
    passage = [f"passage {i}" for i in range(12)]
    docs = {i: "\n".join(rng.choices(pool, k=rng.randint(1, 12)) + (passage if i % 3 == 0 else [f"own {i}"])) for i in range(150)}
    long = " ".join(f"w{i}" for i in range(51))
    docs |= {400 + i: f"own {i}\n{long}\nown too {i}" for i in range(5)} | {410: "x\nx\nx\nx", 411: "a\nb\na\nb\na"}
    docs[500] = docs[501] = "\n" * 30
    docs |= {600: "", 601: "a", 602: "a"}
    df = spark.createDataFrame([(d, t, "e", 1) for d, t in docs.items()], "doc_id long, text string, rest string, N_LINES int").repartition(4)
    got = remove_repeated_chunks(df)
    assert got.columns == ["doc_id", "text", "rest", "n_lines", "n_removed"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {d: (r.text, r.n_removed) for d, r in rows.items()} == brute(docs)
    assert all(rows[d].n_lines == t.count("\n") + 1 for d, t in docs.items())
    assert sum(r.n_removed for r in rows.values()) > 400


def test_shifted_passages_share_chunks(spark):
    passage = "\n".join(f"shared line number {i}" for i in range(30))
    df = spark.createDataFrame([(1, passage), (2, "new head\n" + passage), (3, "a\nb\n" + passage + "\nend")], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in remove_repeated_chunks(df).collect()}
    assert removed[1] == 0 and removed[2] >= 28 and removed[3] >= 28


def test_planted_passages_go_and_clean_lines_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(rng.randint(3, 30)) for _ in range(n)] for n in (2, 3, 4, 5, 6, 8, 10) for _ in range(30)] + [[line(51)] for _ in range(30)]
    rows, planted = [], {}
    for i, p in enumerate(passages):
        for copy in range(3):
            own = [line(rng.randint(1, 20)) for _ in range(8)]
            at = rng.randint(0, 8)
            rows.append((i * 3 + copy, "\n".join(own[:at] + p + own[at:])))
            planted[i * 3 + copy] = (p, own)
    got = {r.doc_id: r for r in remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    touched, lost = {}, 0
    for d, (p, own) in planted.items():
        left = got[d].text.split("\n")
        assert [x for x in left if x in set(own)] == own  # own lines stay
        if d % 3 == 0:
            assert got[d].n_removed == 0
        else:
            touched.setdefault(len(p), []).append(got[d].n_removed > 0)
            lost += got[d].n_removed / len(p) / (2 * len(passages))
    assert all(sum(x) >= 0.9 * len(x) for n, x in touched.items() if n != 2) and sum(touched[2]) >= 0.85 * len(touched[2])
    assert sum(map(sum, touched.values())) >= 0.95 * sum(map(len, touched.values())) and lost > 0.9


def test_nulls_repeats_and_empty(spark):
    text = "\n".join(f"l{i}" for i in range(20))
    rows = [(None, None), (None, text), (5, text), (5, text), (7, None)]
    got = remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), Chunking(window=3, divisor=30)).collect()
    assert sorted((r.doc_id or 0, r.text is None, r.n_removed > 0) for r in got) == [
        (0, False, False), (0, True, False), (5, False, True), (5, False, True), (7, True, False)]
    assert remove_repeated_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0
