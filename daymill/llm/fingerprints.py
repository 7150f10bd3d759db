"""Merkle-tree fingerprints of documents.

A text is cut into sections (after blank lines), those into paragraphs (lines) and those into
sentences, long ones also at blanks that their characters choose; every cut keeps its characters.  A leaf is the hash of a sentence, an inner node the
hash of its children, and the root covers the whole text: equal texts have equal roots.  The
fingerprint is the root followed by the tree in order: ``#`` a section, ``|`` a paragraph, a blank
and a sentence with its length, each as 8 hex digits of its hash.

:func:`likeness` compares two fingerprints, :func:`differing_paragraphs` descends through
sections and paragraphs to the edited places.  Everything is a Column expression.

Rows: a null or empty text has the fingerprint of the empty tree; texts of any length are read whole; repeated
rows have equal fingerprints.  :func:`with_next` sorts null ids last and equal ids by text, gives an empty table
for an empty table, and a column of the table that has the name of a result gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymill.llm.base import free_name, query, table

SECTION = r"(?s).+?(?:\n\n+|\z)"
#: A leaf ends at a sentence mark; from 48 characters on also at a blank after one of the printable ASCII characters
#: (signs, digits, letters) whose code is a multiple of 7 or 11, which the text itself chooses.
SENTENCE = r"(?s).{1,48}?(?:[.!?] |[。！？])|.{48,}?(?:[.!?] |[。！？]|[!#*,178?BFMTX\[bcinpwy~] )|.+\z"
#: Rows of one bucket of :func:`with_next`, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16


def fingerprint(text: Column) -> Column:
    """Root and tree of ``text``; the empty tree for null."""
    short = lambda h: F.substring(h, 1, 8)
    join = lambda a, field: F.array_join(F.transform(a, lambda x: x[field]), "")

    def leaf(s: Column) -> Column:
        h = F.md5(F.encode(s, "UTF-8"))
        return F.struct(h.alias("h"), F.concat(F.lit(" "), short(h), F.lower(F.hex(F.length(s)))).alias("s"))

    def node(mark: str, children: Column) -> Column:
        # transforms over one element give a value a name, so it is computed once
        made = F.transform(F.array(children), lambda kids: F.struct(
            F.md5(F.encode(join(kids, "h"), "UTF-8")).alias("h"), join(kids, "s").alias("below")))[0]
        return F.transform(F.array(made), lambda n: F.struct(
            n["h"].alias("h"), (F.concat(F.lit(mark), short(n["h"]), n["below"]) if mark else F.concat(n["h"], n["below"])).alias("s")))[0]

    def paragraph(p: Column) -> Column:
        return node("|", F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), leaf))

    def section(s: Column) -> Column:
        return node("#", F.transform(F.split(s, "\n"), paragraph))

    return node("", F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTION), F.lit(0)), section))["s"]


def likeness(a: Column, b: Column) -> Column:
    """Share of characters in equal branches: 1 for equal roots, else over distinct sentences."""
    leaves = lambda f: F.array_distinct(F.regexp_extract_all(f, F.lit(" ([0-9a-f]+)"), F.lit(1)))
    chars = lambda x: F.aggregate(
        x, F.lit(0).cast("long"), lambda n, s: n + F.conv(F.substring(s, 9, 16), 16, 10).cast("long"))
    both = F.transform(F.array(F.struct(leaves(a).alias("a"), leaves(b).alias("b"))), lambda x: F.struct(
        chars(F.array_intersect(x["a"], x["b"])).alias("common"), (chars(x["a"]) + chars(x["b"])).alias("all")))[0]
    share = F.transform(F.array(both), lambda x: F.when(x["all"] > 0, 2.0 * x["common"] / x["all"]).otherwise(0.0))[0]
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), 1.0).otherwise(share)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``b`` that lie in no section of ``a`` and are in no paragraph of ``a``."""
    parts = lambda f, mark: F.regexp_extract_all(f, F.lit(rf"[{mark}]([0-9a-f]{{8}})"), F.lit(1))
    sections = F.regexp_extract_all(b, F.lit("#[^#]*"), F.lit(0))
    marked = F.flatten(F.transform(sections, lambda s: F.transform(
        parts(s, "|"), lambda p: ~F.array_contains(parts(a, "#"), F.substring(s, 2, 8)) & ~F.array_contains(parts(a, "|"), p))))
    return F.filter(F.transform(marked, lambda m, i: F.when(m, i.cast("long"))), lambda i: i.isNotNull())


def with_next(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """Add ``next_<column>``: that column of the row with the next larger key; the last row gets the first's.

    Buckets are ranges of keys whose first keys are keys of the table.  A bucket's first rows are
    also sent to the bucket before, so every bucket knows what follows it: one shuffle.
    """
    nums = docs.agg(F.count("*").alias("n"), F.count(key).alias("keys")).first()
    buckets = max(1, min(MOST_BUCKETS, nums["n"] // BUCKET_ROWS))
    bounds: list = []
    if nums["keys"] and buckets > 1:
        shares = [i / buckets for i in range(buckets)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * buckets)).alias("p"), F.min(key).alias("m")).first()
        bounds = sorted({found["m"], *found["p"]})
    bucket, guest, order = (free_name(docs, n) for n in ("bucket", "guest", "order"))
    if len(bounds) < 2:
        rows, bounds = docs.select("*", F.lit(0).alias(bucket), F.lit(False).alias(guest)), []
    else:
        step = math.isqrt(len(bounds)) + 1
        coarse, fine = F.array(*map(F.lit, bounds[step - 1::step])), F.array(*map(F.lit, bounds))
        below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(key)))
        at = F.when(F.col(key).isNull(), len(bounds) - 1).otherwise(
            below(coarse) * step + below(F.slice(fine, below(coarse) * step + 1, F.lit(step))) - 1)
        first = F.array_contains(fine, F.col(key))
        places = F.array(F.struct(F.col(bucket).alias("b"), F.lit(False).alias("g")))
        before = F.array(F.struct(((F.col(bucket) + len(bounds) - 1) % len(bounds)).alias("b"), F.lit(True).alias("g")))
        rows = docs.withColumn(bucket, at).withColumn(
            guest, F.explode(F.when(first, F.concat(places, before)).otherwise(places)))
        rows = rows.withColumn(bucket, F.col(f"{guest}.b")).withColumn(guest, F.col(f"{guest}.g"))
    w = Window.partitionBy(bucket).orderBy(F.col(guest), F.col(key).asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in columns))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.lead(F.struct(*columns)).over(w)
    if not bounds:
        after = F.coalesce(after, F.first(F.struct(*columns)).over(whole))
    return rows.withColumn(order, after).where(~F.col(guest)).select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in {f"next_{n}".lower() for n in columns}),
        *(F.col(f"{order}.{c}").alias(f"next_{c}") for c in columns))


@query("op7_merkle_fingerprints", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (
  SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id NULLS LAST, t), first_value(t) OVER (ORDER BY doc_id NULLS LAST, t)) AS nt FROM d),
x AS (SELECT doc_id, n, t, nt, left(t, n - n // 4) || left(nt, n // 4) AS et FROM e),
v AS (SELECT DISTINCT s FROM (SELECT t AS s FROM x UNION ALL SELECT et FROM x)),
l AS (SELECT s, list_transform(regexp_extract_all(s, '(?s).+?(?:\n\n+|\z)'), lambda a: list_transform(string_split(a, chr(10)), lambda p:
  list_transform(regexp_extract_all(p, '(?s).{1,48}?(?:[.!?] |[。！？])|.{48,}?(?:[.!?] |[。！？]|[!#*,178?BFMTX\[bcinpwy~] )|.+\z'), lambda q: {'h': md5(q), 's': ' ' || left(md5(q), 8) || lower(to_hex(length(q)))}))) AS k FROM v),
p AS (SELECT s, list_transform(k, lambda a: list_transform(a, lambda b: {
  'h': md5(coalesce(array_to_string(list_transform(b, lambda c: c.h), ''), '')), 's': coalesce(array_to_string(list_transform(b, lambda c: c.s), ''), '')})) AS k FROM l),
g AS (SELECT s, list_transform(k, lambda a: {'h': md5(coalesce(array_to_string(list_transform(a, lambda c: c.h), ''), '')),
  's': coalesce(array_to_string(list_transform(a, lambda c: '|' || left(c.h, 8) || c.s), ''), '')}) AS k FROM p),
f AS (SELECT s, md5(coalesce(array_to_string(list_transform(k, lambda c: c.h), ''), ''))
  || coalesce(array_to_string(list_transform(k, lambda c: '#' || left(c.h, 8) || c.s), ''), '') AS fp FROM g),
m AS (SELECT x.doc_id, x.n, x.et, a.fp AS fa, b.fp AS fb, c.fp AS fc,
    list_distinct(regexp_extract_all(a.fp, ' ([0-9a-f]+)', 1)) AS la, list_distinct(regexp_extract_all(b.fp, ' ([0-9a-f]+)', 1)) AS lb,
    list_distinct(regexp_extract_all(c.fp, ' ([0-9a-f]+)', 1)) AS lc
  FROM x JOIN f a ON a.s = x.t JOIN f b ON b.s = x.et JOIN f c ON c.s = x.nt),
w AS (SELECT *, coalesce(list_sum(list_transform(la, lambda y: ('0x' || y[9:])::BIGINT)), 0) AS wa,
    coalesce(list_sum(list_transform(lb, lambda y: ('0x' || y[9:])::BIGINT)), 0) AS wb, coalesce(list_sum(list_transform(lc, lambda y: ('0x' || y[9:])::BIGINT)), 0) AS wc,
    coalesce(list_sum(list_transform(list_intersect(la, lb), lambda y: ('0x' || y[9:])::BIGINT)), 0) AS wab,
    coalesce(list_sum(list_transform(list_intersect(la, lc), lambda y: ('0x' || y[9:])::BIGINT)), 0) AS wac FROM m)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN left(fa, 32) = left(fb, 32) THEN 1.0::DOUBLE WHEN wa + wb > 0 THEN 2.0::DOUBLE * wab::DOUBLE / (wa + wb)::DOUBLE ELSE 0.0::DOUBLE END AS near_edited,
  CASE WHEN left(fa, 32) = left(fc, 32) THEN 1.0::DOUBLE WHEN wa + wc > 0 THEN 2.0::DOUBLE * wac::DOUBLE / (wa + wc)::DOUBLE ELSE 0.0::DOUBLE END AS near_next
FROM w""")
def op7_merkle_fingerprints(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", "text", "fingerprint")
    n = F.length("text")
    swap = F.floor(n / 4).cast("int")
    edited = docs.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), n - swap), F.substr("next_text", F.lit(1), swap)))
    done = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
