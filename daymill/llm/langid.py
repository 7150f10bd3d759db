"""Language identification in two steps: the family, then one-versus-one machines within it.

A text is the square root of its shares of hashed 1- to 3-letter sequences, over the whole text.
Languages whose mean texts are alike form families (average linkage, about as many families as the
square root of the number of languages).  Linear support vector machines tell each family from the rest;
within the best family, one machine per pair of languages votes with its margin.

The machines are fitted on a bounded sample of labelled rows: ``PER_LANGUAGE`` rows of each language
(fewer beyond ``SAMPLE`` in all), those with the smallest seeded hash of id and text.  Everything else covers all rows.

Rows: a null text, or one without a letter, is ``und`` with score 0; null labels are not learned from;
without labels all texts are ``und``; a single language is always the answer; repeated rows
get equal answers; an empty table gives an empty table.  Columns are kept; a column of the name of a result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, slices, table, with_fields

DIMENSIONS = 4096
#: Rows to learn from: of a language, and of all together; more languages than ``MOST_LANGUAGES`` are refused.
PER_LANGUAGE, SAMPLE, MOST_LANGUAGES = 500, 4000, 200
_SLICE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Where single gaps between words are counted; they say nothing.
_BLANK = (32 * _MULTIPLIER + 1) % (1 << 64) >> 52


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def features(text: str | None) -> np.ndarray | None:
    """The vector of a text; None without a letter."""
    counts = np.zeros(DIMENSIONS)
    if text:
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        letter = _letters()[points]
        if letter.any():
            points = np.where(letter, points, 32)
            for i in range(0, len(points), _SLICE):
                part = points[i:i + _SLICE + 2].astype(np.uint64)
                gram = part
                for n in range(1, 4):
                    if n > 1:
                        gram = gram[:-1] * np.uint64(0x10FFFF + 2) + part[n - 1:]
                    mixed = (gram * np.uint64(_MULTIPLIER) + np.uint64(n)) >> np.uint64(52)
                    counts += np.bincount(mixed[:_SLICE].astype(np.int64), minlength=DIMENSIONS)
            counts[_BLANK] = 0
            return np.sqrt(counts / max(counts.sum(), 1))
    return None


def support_vectors(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine, by dual coordinate descent; ``y`` is 1 or -1."""
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    norm = np.einsum("ij,ij->i", x, x)
    for i in np.concatenate([np.random.default_rng(r).permutation(len(x)) for r in range(rounds)]):
        g = y[i] * (w @ x[i]) - 1
        b = min(max(a[i] - g / norm[i], 0), c)
        if b != a[i]:
            w += (b - a[i]) * y[i] * x[i]
            a[i] = b
    return w


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        best, score = 0, 1.0
        if len(self.families) > 1:
            likely = np.exp(4 * (self.family_weights @ x))
            best = int(np.argmax(likely))
            score = float(likely[best] / likely.sum())
        members = self.families[best]
        if len(members) == 1:
            return self.languages[members[0]], score
        votes = dict.fromkeys(members, 0.0)
        for i, j in combinations(members, 2):
            p = float(1 / (1 + np.exp(-4 * (self.pair_weights[i, j] @ x))))
            votes[i] += p
            votes[j] += 1 - p
        pick = max(members, key=lambda i: votes[i])
        return self.languages[pick], score * votes[pick] / (len(members) - 1)


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages with similar means, by average linkage."""
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    alike, groups = unit @ unit.T, [[i] for i in range(len(means))]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def train(labelled: DataFrame, seed: int = 7) -> Model:
    """Fit on ``labelled`` (key, text, lang)."""
    # with the text, as rows may share a key or have none
    seeded = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("text")), "UTF-8"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", seeded.alias("h"))
    langs = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return Model()
    most = max(20, min(PER_LANGUAGE, SAMPLE // len(langs)))
    # far more hashes than rows wanted lie below such a share of all hashes; the rest need not meet
    shares = F.create_map(*(F.lit(x) for lang, n in langs.items() for x in (lang, min(1.0, 4 * most / n))))
    near = labelled.where(
        F.conv(F.substring("h", 1, 8), 16, 10).cast("long") <= shares[F.col("lang")] * float(1 << 32))
    ranked = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [(lang, x) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "x": [r[1].astype("<f4").tobytes() for r in rows]},
                                             pa.schema([("lang", pa.string()), ("x", pa.binary())]))

    rows = ranked.where(F.col("i") <= most).select("lang", "text").mapInArrow(vectors, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    langs = sorted({r["lang"] for r in rows})  # those with letters
    if not langs:
        return Model()
    y = np.array([langs.index(r["lang"]) for r in rows])
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], np.float64)
    groups = families(np.array([x[y == i].mean(axis=0) for i in range(len(langs))]))
    of = {i: g for g, members in enumerate(groups) for i in members}
    family = np.array([of[i] for i in y])
    weights = np.array([support_vectors(x, np.where(family == g, 1.0, -1.0)) for g in range(len(groups))]) if len(groups) > 1 else None
    pairs = {}
    for members in groups:
        for i, j in combinations(members, 2):
            mine = (y == i) | (y == j)
            pairs[i, j] = support_vectors(x[mine], np.where(y[mine] == i, 1.0, -1.0))
    return Model(langs, groups, weights, pairs)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score; only ``text`` is looked at."""
    schema = with_fields(docs, **{lang: T.StringType(), score: T.DoubleType()})
    kept = schema.names[:-2]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text):
            found = []
            for t in b.column(text).to_pylist():
                x = features(t) if m.languages else None
                found.append(("und", 0.0) if x is None else m.predict(x))
            yield pa.RecordBatch.from_arrays([
                *(b.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*kept, lang, score])

    return docs.mapInArrow(run, schema)


def held_out(key: str) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learned from its labelled rows that are not held out."""
    model = train(docs.where(~held_out(key)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")))
    return predict(docs, model, text)


@query("op10_language_id")
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
