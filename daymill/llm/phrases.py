"""Phrase collocations by Rabin-Karp fingerprints of n-grams.

1. Texts are split into words once.  Each written row holds the words of some texts of one language:
   their spelling, one 64-bit hash per distinct word, and the sequence as numbers.
2. For n = 1, 2, ... a pass over these rows takes the fingerprint of every n-gram from prefix
   polynomials over the word hashes (numpy, modulo 2**64), counts equal ones within the row, and a shuffle sums the counts by
   fingerprint, with a pointer to a row that holds it and a sum of check values from other multipliers.  An n-gram is passed over when
   one of its two (n-1)-grams is known to be rarer than ``least``, as it is then rarer itself.  What is known is a bitmap over
   fingerprints, filled by Spark and of fixed size; a full bitmap passes more n-grams to the shuffle and never loses one.
3. Pointers of frequent fingerprints are sent to their rows, where each is read back as text once.  Its check value
   times its count must give the sum; where it does not, several phrases share the fingerprint, and these are counted again by
   their words.  So only frequent phrases become text.
4. Cuts of a candidate join the counts of their parts; parts of a frequent phrase are frequent.

Tasks hold one row of about ``CHUNK`` bytes of text (or one text) at a time.  Common phrases are counted within
a row before any shuffle, so a phrase or language with a third of all words gathers nowhere.

Rows: null and empty texts have no words; a null language is ``und``; repeated rows count as often as
they are there; texts are read whole; equal scores and counts rank by the phrase in UTF-8 byte order; an empty
table gives an empty table.  Only the two named columns are read, so other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymill.llm.base import query, slices, table
from daymill.session import staged, work_folder

#: Bytes of text in one row of words.
CHUNK = 10 << 20
#: Size of a bitmap over fingerprints: 2**26 bits are 8 MB.
FILTER_BITS = 26
#: Bits of a fingerprint; rows of a shuffle are sorted by it, so fewer bits compress well.
PRINT_BITS = 56
#: Bits of a check value; times a count it must fit 64 bits.
CHECK_BITS = 24
#: Rows of words of one task at most, and the bits of a task number that fingerprints spread pointers over.
TASK_ROWS, SPREAD = 1 << 12, 0xFFFF
_BASE = 0x9E3779B97F4A7C15
_WRAP = 1 << 64

# Bytes that end a piece, and the byte that is a blank besides the space.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TAB = b"\t"


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words found ``least`` times; the first ``top`` of a language."""

    longest: int = 5
    least: int = 100
    top: int = 2000


def _folding() -> bytes:
    """Byte table: A-Z in lower case, ends of pieces as full stops, tabs as spaces."""
    out = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        out[b] += 32
    for b in PIECE_ENDS:
        out[b] = ord(".")
    out[TAB[0]] = ord(" ")
    return bytes(out)


class _Numbers(dict):
    """Word to number in order of appearance; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


WORDS = "chunk bigint, lang string, n_words bigint, words binary, hashes binary, codes binary"


def word_rows(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of :data:`WORDS`: spelling of the distinct words (by lines), their hashes, and the texts as numbers."""
    fold = _folding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        chunk = count(TaskContext.get().partitionId() * TASK_ROWS)

        def row(name: str, numbers: _Numbers, parts: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.concatenate(parts)
            seed = xxhash.xxh64_intdigest(name.encode())
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in numbers], np.uint64)
            return pa.RecordBatch.from_arrays([
                pa.array([next(chunk)]), pa.array([name]), pa.array([int(np.count_nonzero(codes))], pa.int64()), pa.array([b"\n".join(numbers)], pa.binary()),
                pa.array([hashes.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["chunk", "lang", "n_words", "words", "hashes", "codes"])

        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0
        for b in slices(batches, "text", 4 << 20):
            texts: dict[str, list[bytes]] = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if t:
                    texts.setdefault(name, []).append(t.encode())
            for name, ts in texts.items():
                numbers, parts = held.setdefault(name, (_Numbers({b".": 0}), []))
                found = b".".join([*ts, b""]).translate(fold).replace(b".", b" . ").split()
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, count=len(found)))
                size += sum(map(len, ts))
            if size >= CHUNK:
                yield from (row(k, *held.pop(k)) for k in list(held))
                size = 0
        yield from (row(k, *held.pop(k)) for k in list(held))
        pa.default_memory_pool().release_unused()

    path = work_folder(docs.sparkSession, "words")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, WORDS)
    rows.write.option("maxRecordsPerFile", 4).parquet(path)  # rows are large: few of them meet in memory
    return docs.sparkSession.read.schema(WORDS).parquet(path)


class Grams:
    """The n-grams of one row of words."""

    def __init__(self, hashes: bytes, codes: bytes, prints: int = PRINT_BITS):
        self.unused = np.uint64(64 - prints)
        self.codes = np.frombuffer(codes, np.int32)
        n = len(self.codes)
        self.sums = np.zeros(n + 1, np.uint64)
        self.hashes = np.frombuffer(hashes, np.uint64)
        np.multiply(self.hashes[self.codes], _powers(_BASE, n), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        self.back = _powers(pow(_BASE, -1, _WRAP), n)
        self.ends = np.zeros(n + 1, np.int32)
        np.cumsum(self.codes == 0, dtype=np.int32, out=self.ends[1:])

    def fingerprints(self, n: int) -> np.ndarray:
        """The fingerprint of the ``n`` words from each place on, meaningful where :meth:`inside` holds."""
        k = max(len(self.codes) - n + 1, 0)
        x = self.sums[n:n + k] - self.sums[:k]
        x *= self.back[:k]
        x += np.uint64(n)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x >>= self.unused
        return x

    def inside(self, n: int) -> np.ndarray:
        """Whether no piece ends within the ``n`` words from each place on."""
        k = max(len(self.codes) - n + 1, 0)
        return self.ends[n:n + k] == self.ends[:k]

    def marked(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Places of n-grams whose fingerprint is in the bitmap."""
        at = self.fingerprints(n)
        at &= np.uint64(len(bits) * 8 - 1)
        bit = (at & np.uint64(7)).astype(np.uint8)
        at >>= np.uint64(3)
        return self.inside(n) & (bits[at] >> bit & np.uint8(1)).astype(bool)

    def checks(self, n: int, places: np.ndarray) -> np.ndarray:
        """Check values of the n-grams at ``places``, from the words alone."""
        x = np.zeros(len(places), np.uint64)
        for j in range(n):
            x = (x + self.hashes[self.codes[places + j]]) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        return (x >> np.uint64(64 - CHECK_BITS)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


FOUND = ["fp", "a", "at", "checks"]


def _counted(g: Grams, n: int, ok: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    """Columns :data:`FOUND` of the distinct n-grams where ``ok``, in the order of fingerprints."""
    places = np.flatnonzero(ok)
    if not len(places):
        return
    f = g.fingerprints(n)[places].view(np.int64)
    order = np.argsort(f)
    f, checks = f[order], g.checks(n, places[order])
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    counts, sums, f = np.diff(starts, append=len(f)), np.add.reduceat(checks, starts), f[starts]
    at = chunk ^ (f & SPREAD) * TASK_ROWS
    for i in range(0, len(f), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)]) for x in (f, counts, at, sums)], names=FOUND)


def frequent_fingerprints(rows: DataFrame, n: int, known: np.ndarray | None, least: int, prints: int = PRINT_BITS) -> DataFrame:
    """Fingerprints of n-grams found at least ``least`` times, both of whose (n-1)-grams are in the bitmap.

    ``at`` is the smallest of the numbers of the rows that hold it, each mixed with the fingerprint, so that rows share the pointers.
    """
    shared = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, hashes, codes in zip(b.column("chunk").to_pylist(), b.column("hashes"), b.column("codes")):
                g = Grams(hashes.as_buffer(), codes.as_buffer(), prints)
                ok = g.inside(n)
                if shared is not None:
                    part = g.marked(n - 1, shared.value)
                    ok &= part[:len(ok)] & part[1:len(ok) + 1]
                yield from _counted(g, n, ok, chunk)
        pa.default_memory_pool().release_unused()  # a worker stays idle for a while

    found = rows.select("chunk", "hashes", "codes").mapInArrow(run, ", ".join(f"{c} bigint" for c in FOUND))
    return found.groupBy("fp").agg(F.sum("a").alias("a"), F.min("at").alias("at"), F.sum("checks").alias("checks")).where(F.col("a") >= least)


def bitmap(fingerprints: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap over the low bits of ``fp``; at most ``2**bits / 64`` numbers reach the driver."""
    at = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    got = fingerprints.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(bit).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("i").to_numpy()] = got.column("w").to_numpy()
    return out.view(np.uint8)


def _texts(g: Grams, words: bytes, places: np.ndarray, n: int) -> pa.Array:
    import pyarrow.compute as pc

    spelt = pa.array(words.decode().split("\n"))
    parts = [spelt.take(pa.array(g.codes[places + j])) for j in range(n)]
    return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def read_back(rows: DataFrame, frequent: DataFrame, prints: int = PRINT_BITS) -> DataFrame:
    """(lang, n, fp, phrase, a, sole) of frequent fingerprints (n, fp, a, at, checks); ``sole``: no other phrase has the fingerprint."""
    chunk = F.col("at").bitwiseXOR(F.col("fp").bitwiseAND(F.lit(SPREAD)) * TASK_ROWS)
    # as many as a row has n-grams, at most
    wanted = frequent.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("n", "fp", "a", "checks")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g = Grams(b.column("hashes")[i].as_buffer(), b.column("codes")[i].as_buffer(), prints)
                n_of, fp, a, checks = (x.to_numpy() for x in b.column("wanted")[i].values.flatten())
                for n in np.unique(n_of).tolist():
                    mine = np.flatnonzero(n_of == n)
                    mine = mine[np.argsort(fp[mine])]
                    f = g.fingerprints(n).view(np.int64)
                    line = np.minimum(np.searchsorted(fp[mine], f), len(mine) - 1)
                    hit = np.flatnonzero((fp[mine][line] == f) & g.inside(n))
                    at, first = np.unique(line[hit], return_index=True)
                    places, mine = hit[first], mine[at]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b.column("lang")[i].as_py()] * len(mine)), pa.array(np.full(len(mine), n, np.int32)), pa.array(fp[mine]),
                        _texts(g, b.column("words")[i].as_py(), places, n), pa.array(a[mine]),
                        pa.array(g.checks(n, places) * a[mine] == checks[mine])], names=["lang", "n", "fp", "phrase", "a", "sole"])

    return rows.join(wanted, "chunk").mapInArrow(run, "lang string, n int, fp bigint, phrase string, a bigint, sole boolean")


def counted_again(rows: DataFrame, shared_prints: DataFrame, least: int, bits: int, prints: int = PRINT_BITS) -> DataFrame:
    """(lang, n, phrase, a) of the phrases with the fingerprints (n, fp), counted by their words."""
    numbers = [r["n"] for r in shared_prints.select("n").distinct().collect()]  # as many as lengths
    maps = rows.sparkSession.sparkContext.broadcast({n: bitmap(shared_prints.where(F.col("n") == n), bits) for n in numbers})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g = Grams(b.column("hashes")[i].as_buffer(), b.column("codes")[i].as_buffer(), prints)
                for n, known in maps.value.items():
                    places = np.flatnonzero(g.marked(n, known))
                    if len(places):
                        grams = np.stack([g.codes[places + j] for j in range(n)], axis=1)
                        _, first, counts = np.unique(grams, axis=0, return_index=True, return_counts=True)
                        at = places[first]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([b.column("lang")[i].as_py()] * len(at)), pa.array(np.full(len(at), n, np.int32)),
                            pa.array(g.fingerprints(n)[at].view(np.int64)), _texts(g, b.column("words")[i].as_py(), at, n), pa.array(counts)],
                            names=["lang", "n", "fp", "phrase", "a"])

    found = rows.mapInArrow(run, "lang string, n int, fp bigint, phrase string, a bigint").join(shared_prints, ["n", "fp"], "left_semi")
    return found.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def phrase_counts(rows: DataFrame, how: Mining, bits: int = FILTER_BITS, prints: int = PRINT_BITS) -> DataFrame:
    """(lang, n, phrase, a): words and phrases found at least ``least`` times, with their exact counts."""
    known, parts = None, []
    for n in range(1, how.longest + 1):
        parts.append(staged(frequent_fingerprints(rows, n, known, how.least, prints), "prints").withColumn("n", F.lit(n)))
        known = bitmap(parts[-1], bits)
    found = staged(read_back(rows, reduce(DataFrame.unionByName, parts), prints), "read-back")
    sole = found.where("sole").select("lang", "n", "phrase", "a")
    several = found.where("not sole").select("n", "fp")
    return sole if several.isEmpty() else sole.unionByName(counted_again(rows, several, how.least, bits, prints))


def collocations(docs: DataFrame, how: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Ranked phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the lowest, over its cuts in two, of ``floor(1000 * a * n / (l * r))`` with the counts of
    the phrase, of both parts and of all words; phrases within a longer one that is as frequent are left out.
    """
    rows = word_rows(docs, text, lang)
    total = rows.groupBy("lang").agg(F.sum("n_words").alias("n"))
    counted = staged(phrase_counts(rows, how), "phrases")
    words = F.split("phrase", " ", -1)
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    candidates = counted.where("n >= 2").select("lang", "phrase", "a", F.col("n").alias("size"), words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size")).alias("right"))
    f = lambda name, count: counted.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"]).join(total, "lang").withColumns({
        "over": big("a") * big("n") * 1000, "under": big("l") * big("r")}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: part(s, m))))
    around = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("b.a")))
    ranked = kept.selectExpr("lang", "phrase", "b.*", "row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, b.a DESC, phrase) AS rank")
    return ranked.where(F.col("rank") <= how.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_phrase_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(p), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM p, range(1, 6) n(k), range(1, len(w) - k + 2) s(i) GROUP BY ALL),
t AS (SELECT lang, sum(a)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT * FROM g WHERE a >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y, i FROM c, range(1, 5) s(i) WHERE i < k),
sc AS (SELECT cut.lang, cut.phrase, cut.a, fl.a AS l, fr.a AS r, t.n, i, (1000::HUGEINT * cut.a * t.n) // (fl.a::HUGEINT * fr.a) AS score
  FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = x JOIN f fr ON fr.lang = cut.lang AND fr.phrase = y JOIN t ON t.lang = cut.lang),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, range(2, 5) q(m), range(1, 5) s(i) WHERE m < k AND i + m - 1 <= k),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.a >= 100 * b.a))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
  FROM kept) WHERE rank <= 2000""")
def op12_phrase_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))
