"""Removal of repeated multi-line chunks with content-defined borders.

A rolling hash over the hashes of the last ``window`` lines decides where a chunk ends, so borders
depend on the lines alone and a shift of the text does not move them.  Borders fall often (one line in ``divisor`` is none),
and a line of more than ``long_words`` words has borders on both sides.  A chunk is looked up together with the
line before it, so neighbours overlap and a shared passage of two lines already holds one; a long line is also looked up alone.
A chunk that occurs more than once in the corpus stays at its first place (smallest id, then text
hash, then line) and is removed elsewhere, once its bytes equal those of the first; of a chunk that overlaps its own first place only
the rest goes.  A text loses the union of its removed chunks.

Only narrow rows (hash, id, place) are grouped.  The texts of repeated chunks are then compared by their minimum and
maximum per hash, which Spark takes before the shuffle, so a chunk in a third of all documents is compared in all tasks; only where
two texts share a hash do rows meet the text of the first.  All documents move by their own key, once where Spark
reuses the exchange.

Rows: a null text stays null and an empty one empty; a document that loses all lines becomes empty; null
ids count as the smallest; rows with equal id and text are treated alike (they keep or lose the
same chunks); chunks without visible characters are left alone; very long texts are read whole, in time
linear in their lines; an empty table gives an empty table.  Extra columns are kept; a column of the name of a result gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.llm.base import query, table
from daymill.session import staged

_BASE = 1_000_003


@dataclass(frozen=True)
class Chunking:
    """A chunk ends unless the rolling hash over ``window`` lines is a multiple of ``divisor``, and around long lines."""

    window: int = 2
    divisor: int = 32
    long_words: int = 50


def chunks(text: Column, how: Chunking) -> Column:
    """Array of (start, n, h): the lines, from 0, that are looked up in ``text``, and their hash."""
    mod = 1 << 28
    line_hash = lambda l: F.conv(F.substring(F.md5(F.encode(l, "UTF-8")), 1, 7), 16, 10).cast("long")
    n_words = lambda l: F.size(F.array_remove(F.split(l, r"[\x20\x09-\x0D]+"), ""))
    is_long = lambda l: F.when(F.length(l) > 2 * how.long_words, n_words(l) > how.long_words).otherwise(False)
    lines = F.split(text, "\n")
    named = F.array(F.struct(lines.alias("lines"), F.transform(lines, line_hash).alias("hashes"), F.transform(lines, is_long).alias("long"),
                             F.transform(lines, lambda l: l.rlike(r"[^\x20\x09-\x0D]")).alias("seen")))

    def ends(x: Column) -> Column:
        hashes = x["hashes"]
        rolled = lambda i: sum(
            (F.coalesce(F.get(hashes, i - j), F.lit(0)) * (pow(_BASE, j, mod)) % mod for j in range(1, how.window)), F.get(hashes, i)) % mod
        places = F.sequence(F.lit(0), F.size(hashes) - 1)
        return F.filter(places, lambda i: (rolled(i) % how.divisor != 0) | F.get(x["long"], i) | F.coalesce(F.get(x["long"], i + 1), F.lit(True)))

    def full(x: Column) -> Column:
        part = lambda start, end: F.when(
            F.array_contains(F.slice(x["seen"], start + 1, end - start + 1), True), F.struct(
                start.alias("start"), (end - start + 1).alias("n"), F.xxhash64(F.slice(x["lines"], start + 1, end - start + 1)).alias("h")))

        def looked_up(e: Column, k: Column) -> Column:
            start = F.coalesce(F.get(x["ends"], k - 1) + 1, F.lit(0))
            alone = F.when((e > start) | F.get(x["long"], e), part(start, e))
            return F.array(alone, F.when(start > 0, part(start - 1, e)))

        return F.filter(F.flatten(F.transform(x["ends"], looked_up)), lambda c: c.isNotNull())

    with_ends = F.transform(named, lambda x: F.struct(
        x["lines"].alias("lines"), x["long"].alias("long"), x["seen"].alias("seen"), ends(x).alias("ends")))
    return F.transform(with_ends, full)[0]


def repeated_chunks(docs: DataFrame, how: Chunking) -> DataFrame:
    """Rows (k, th, start, end) of the lines to remove from documents (k, th, text)."""
    found = staged(docs.select("k", "th", F.explode(chunks(F.col("text"), how)).alias("c")).select("k", "th", "c.*"), "chunks")
    place = F.struct("k", "th", "start")
    repeats = found.groupBy("h", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "n", "first")
    held = staged(found.join(repeats, ["h", "n"]), "repeats")
    wanted = held.groupBy("th", "k").agg(F.collect_set(F.struct("start", "n", "h", "first")).alias("c")).withColumnsRenamed({"th": "th2", "k": "k2"})
    texts = docs.join(wanted, (F.col("th") == F.col("th2")) & F.col("k").eqNullSafe(F.col("k2"))).select(
        "k", "th", F.split("text", "\n").alias("lines"), F.explode("c").alias("c")).select(
        "k", "th", "c.*", F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.n")), "\n").alias("text"))
    texts = staged(texts, "texts")
    seen = texts.groupBy("h", "n").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    seen = staged(seen.select("h", "n", (F.col("lo") == F.col("hi")).alias("equal")), "compared")
    clashing = texts.join(seen.where("not equal").select("h", "n"), ["h", "n"])
    first = clashing.where(place == F.col("first")).select("h", "n", F.col("text").alias("first_text")).distinct()
    equal = held.join(seen.where("equal").select("h", "n"), ["h", "n"]).unionByName(
        clashing.join(first, ["h", "n"]).where("text = first_text").select(*held.columns))
    end = F.col("start") + F.col("n") - 1
    own = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("th") == F.col("first.th"))
    start = F.when(own, F.greatest("start", F.col("first.start") + F.col("n"))).otherwise(F.col("start"))
    return equal.where(place != F.col("first")).select("k", "th", start.alias("start"), end.alias("end"))


def remove_repeated_chunks(docs: DataFrame, how: Chunking = Chunking(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text``, and ``n_lines`` and ``n_removed`` before and of the cut."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rest = [F.col(f"`{c}`") for c in names if c not in (key, text)]
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))
    cut = repeated_chunks(rows.select("k", "th", "text"), how).groupBy(F.col("th").alias("th2"), F.col("k").alias("k2")).agg(
        F.array_sort(F.collect_set(F.struct("end", "start"))).alias("cut"))  # ends grow with starts
    joined = rows.join(cut, (F.col("th") == F.col("th2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
    lines, n = F.split("text", "\n"), F.size(F.split("text", "\n"))
    since = lambda i: F.coalesce(F.get("cut", i - 1)["end"] + 1, F.lit(0))
    between = F.flatten(F.transform("cut", lambda c, i: F.slice(lines, since(i) + 1, F.greatest(c["start"] - since(i), F.lit(0)))))
    after = F.element_at("cut", -1)["end"] + 1
    kept = F.when(F.col("cut").isNotNull(), F.concat(between, F.slice(lines, after + 1, n - after)))
    out = {key: F.col("k"), text: F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.col("kept"), "\n"))}
    return joined.withColumn("kept", kept).select(
        *(out.get(c, F.col(f"rest.`{c}`")).alias(c) for c in names), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(n - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"))


def oracle(docs: str) -> str:
    """SQL parts l0 to lines: what :func:`remove_repeated_chunks` does to the table ``docs``."""
    return rf"""
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs}),
l1 AS (SELECT *, ('0x' || left(md5(l), 7))::BIGINT AS h, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 50 AS lg FROM l0),
l2 AS (SELECT *, (h + coalesce(lag(h) OVER w, 0) * {_BASE} % 268435456) % 268435456 % 32 <> 0 OR lg OR coalesce(lead(lg) OVER w, true) AS ends
  FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l3 AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM l2),
c1 AS (SELECT doc_id, min(i) AS s, max(i) AS e, string_agg(l, chr(10) ORDER BY i) AS t, bool_or(lg) AS lg FROM l3 GROUP BY doc_id, c),
c2 AS (SELECT doc_id, s, e, t FROM c1 WHERE e > s OR lg
  UNION ALL SELECT c1.doc_id, s - 1, e, p.l || chr(10) || t FROM c1 JOIN l0 p ON p.doc_id = c1.doc_id AND p.i = s - 1),
c3 AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(s) OVER w AS fs FROM c2 WHERE regexp_matches(t, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY t ORDER BY doc_id, s)),
c4 AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(s, fs + e - s + 1) ELSE s END, e + 1)) AS i FROM c3 WHERE doc_id <> fd OR s <> fs),
lines AS (SELECT l0.doc_id, l0.l, l0.i, c4.i IS NOT NULL AS gone FROM l0 LEFT JOIN c4 ON l0.doc_id = c4.doc_id AND l0.i = c4.i)"""


@query("op2_line_chunks", f"""
WITH {oracle('documents')}
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
  count(*) FILTER (gone) AS n_removed FROM lines GROUP BY doc_id""")
def op2_line_chunks(spark, sf):
    return remove_repeated_chunks(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
