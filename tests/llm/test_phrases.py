import random
import re
from collections import Counter

from daymill.llm import phrases
from daymill.llm.phrases import Mining, collocations


def brute(docs, how):
    """Ranked phrases by the definition, over Python lists."""
    f, total = Counter(), Counter()
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, how.longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang or "und", tuple(words[i:i + n])] += 1
    found = {k: a for k, a in f.items() if a >= how.least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in found.items():
        def inside(v):
            return any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(g == lang and len(v) > len(w) and b >= a and inside(v) for (g, v), b in found.items()):
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n))
    return {(lang, i, p.decode(), -a, x, y, n, -s) for lang, rows in out.items()
            for i, (s, a, p, x, y, n) in enumerate(sorted(rows)[:how.top], 1)}


def corpus():
    rng = random.Random(12)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x\x00y", "\x85", "\x1c", "東京", "z", "z"]
    docs = []
    for i in range(300):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", ".", " \x0b"]) for _ in range(rng.randint(0, 40)))
        if i % 4 == 0:
            t += " New york City hall now"
        docs.append((t, rng.choice(["en", "de", None, "und"])))
    docs += [(None, "en"), ("", None), (". , ;", "fr"), ("one two " * 3000, "xx")]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(t, g, 1, "c") for t, g in docs], "text string, lang string, rank int, phrase string").repartition(4)
    for how in (Mining(least=5), Mining(longest=3, least=12, top=7), Mining(longest=2, least=1)):
        rows = collocations(df, how).collect()
        assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == brute(docs, how)


def test_small_bitmaps_and_colliding_fingerprints_change_nothing(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "text string, lang string")
    rows = phrases.word_rows(df)
    want = {tuple(r) for r in phrases.phrase_counts(rows, Mining(least=5)).collect()}
    assert {tuple(r) for r in phrases.phrase_counts(rows, Mining(least=5), bits=8).collect()} == want
    seen = []
    again = phrases.counted_again
    monkeypatch.setattr(phrases, "counted_again", lambda rows, several, *how: seen.append(several.count()) or again(rows, several, *how))
    assert {tuple(r) for r in phrases.phrase_counts(rows, Mining(least=5), prints=5).collect()} == want and seen[0] > 50  # nearly all collide


def test_empty_and_repeated_rows(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
    same = spark.createDataFrame([("Big Apple", "en")] * 100 + [("big", "en")], "text string, lang string")
    assert [tuple(r) for r in collocations(same).collect()] == [("en", 1, "big apple", 100, 101, 100, 201, 1990)]
