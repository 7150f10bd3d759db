"""Exact Jaccard join of documents on word shingles, by a grouped prefix join.

1. *Shared shingles.*  Blocks of documents send their shingles, as short fingerprints packed by hash
   bucket, and learn which occur in other documents too.  A document can only link when enough of its
   shingles are shared, so most documents end here.  Collisions only let a few more go on.
2. *Groups.*  Documents with equal sets are one class.  Shingles are ordered from rare to frequent; two sets
   that are similar enough share one in their prefixes.  Classes with identical prefix and size are one group.
3. *Pairs.*  Groups that share a prefix shingle, fit in size, have enough left behind it and are not
   connected yet are paired: first each shingle's groups with one of them (the one with the fewest
   shingles of its own, then others), for some rounds, then all remaining pairs.  Pairs of groups
   expand to pairs of classes.
4. *Verification* counts the common shingles of each pair; links join components.

No set of rows is held whole: shingle lists are split by hash, joins by key, and a hot shingle
sends one entry per block.  Links inside a component that is already connected are not needed for
component ids; every pair across components is verified, so no link between components is lost.

Rows: a null or blank text has no shingles and links with nothing; fewer than ``k`` words are one
shingle; equal texts are one class; null ids are allowed (a component's id is its smallest id
that is not null); an empty table gives an empty table; extra columns are left out.  Rows of a
partition must come in a stable order, as a table's do: a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, slices, table
from daymill.llm.components import components
from daymill.session import staged

BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 15
#: Rounds of pairing with the first group of a shingle before all remaining pairs are formed.
STAR_ROUNDS = 3
KEEP_WORDS = 100_000
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEEP_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    n = min(k, len(w))
    out = w[:len(w) - n + 1].copy()
    for j in range(1, n):
        out *= _MULTIPLIER
        out += w[j:len(w) - n + 1 + j]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _class(sets: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(sets.tobytes())


def _pack_steps(docs: np.ndarray) -> bytes:
    """Ascending 16-bit numbers as steps of one byte; 255 stands for a longer step, listed at the end."""
    steps = np.diff(docs, prepend=0)
    long = steps[steps >= 255]
    return len(long).to_bytes(4, "little") + long.astype("<u2").tobytes() + np.minimum(steps, 255).astype(np.uint8).tobytes()


def _unpack_steps(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    steps = np.frombuffer(data, np.uint8, offset=4 + 2 * n).astype(np.int64)
    steps[steps == 255] = np.frombuffer(data, "<u2", n, 4)
    return np.cumsum(steps)


_BLOCKS = [("block", pa.int64()), ("bucket", pa.int64()), ("docs", pa.binary()), ("prints", pa.binary()), ("known", pa.binary())]


def _three_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_three(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
    return b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16


def shared_counts(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, class, shared) of each row of ``docs`` (key, text): its shingles and how many others have too.

    ``shared`` may be a little too large, never too small.
    """
    kind = docs.schema["key"].dataType
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = [T.StructField("keys", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("classes", T.ArrayType(T.StringType()))]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("docs", T.BinaryType()),
                           T.StructField("prints", T.BinaryType()), T.StructField("known", T.BinaryType()), *heads])
    counted = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.BinaryType()), *heads])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, hashes, keys, sets, held, out = TaskContext.get().partitionId() << 24, _WordHashes(), [], [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            sizes = [len(s) for s in sets]
            tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens)
            tokens, doc = tokens[order], doc[order]
            same = tokens[1:] == tokens[:-1]
            again, follows = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
            follows[1:] = same
            again[1:] |= same
            again[:-1] |= same
            yield pa.RecordBatch.from_pydict({
                "block": [number], "bucket": [-number - 1], "docs": [doc[again].astype("<u2").tobytes()], "prints": [None], "known": [None],
                "keys": [keys], "sizes": [sizes], "classes": [[_class(s) for s in sets]]}, out)
            def split(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Bucket and fingerprint of the picked shingles; both come from their high and low bits."""
                t = tokens[pick]
                return ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (t & np.uint64(0xFFFFFF)).astype(np.int64)

            bucket1, low1 = split(~again)  # in one document of the block
            by = np.lexsort((doc[~again], bucket1))
            mine, low1, bucket1 = doc[~again][by], low1[by], bucket1[by]
            bucket2, low2 = split(again & ~follows)  # in several: shared already, others must learn of it
            edges1 = np.searchsorted(bucket1, np.arange(buckets + 1))
            edges2 = np.searchsorted(bucket2, np.arange(buckets + 1))
            rows = [b for b in range(buckets) if edges1[b] < edges1[b + 1] or edges2[b] < edges2[b + 1]]
            for i in range(0, len(rows), 64):
                part = rows[i:i + 64]
                yield pa.RecordBatch.from_pydict({
                    "block": [number] * len(part), "bucket": part, "docs": [_pack_steps(mine[edges1[b]:edges1[b + 1]]) for b in part],
                    "prints": [_three_bytes(low1[edges1[b]:edges1[b + 1]]) for b in part], "known": [_three_bytes(low2[edges2[b]:edges2[b + 1]]) for b in part],
                    "keys": [None] * len(part), "sizes": [None] * len(part), "classes": [None] * len(part)}, out)

        for b in slices(batches, "text", 2 << 20):
            out = out or pa.schema([*_BLOCKS, ("keys", pa.list_(b.schema.field("key").type)), ("sizes", pa.list_(pa.int64())), ("classes", pa.list_(pa.string()))])
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                keys.append(key)
                sets.append(shingles(text, k, hashes))
                held += len(text or "")
                if held >= BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                    yield from close()
                    number, keys, sets, held = number + 1, [], [], 0
        if keys:
            yield from close()

    def meet(t: pa.Table) -> pa.Table:
        if t["prints"].null_count:  # a block's own row
            return t.select(counted.names)
        prints, known = [_from_three(x) for x in t["prints"].to_pylist()], [_from_three(x) for x in t["known"].to_pylist()]
        times = np.zeros(1 << 24, np.uint8)
        for x in prints:
            values, n = np.unique(x, return_counts=True)
            times[values] = np.minimum(times[values] + np.minimum(n, 2), 2)
        for x in known:
            times[x] = 2
        docs = [_unpack_steps(d)[times[p] == 2].astype("<u2").tobytes() for d, p in zip(t["docs"].to_pylist(), prints, strict=True)]
        return t.select(["block"]).append_column("docs", pa.array(docs, pa.binary())).append_column(
            "keys", t["keys"]).append_column("sizes", t["sizes"]).append_column("classes", t["classes"])

    def total(t: pa.Table) -> pa.Table:
        head = t.filter(t["keys"].is_valid())
        keys, sizes, classes = (head[c].combine_chunks().flatten() for c in ("keys", "sizes", "classes"))
        shared = np.zeros(len(sizes), np.int64)
        for d in t["docs"].to_pylist():
            shared += np.bincount(np.frombuffer(d, "<u2"), minlength=len(sizes))
        return pa.table({"key": keys, "n": sizes, "class": classes, "shared": shared})

    result = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("class", T.StringType()), T.StructField("shared", T.LongType())])
    return docs.mapInArrow(send, schema).groupBy("bucket").applyInArrow(meet, counted).groupBy("block").applyInArrow(total, result)


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(c, class, n, set): the shingle hashes of each wanted class (class, key), read from one of its documents."""
    kind = T.StructType([T.StructField("class", T.StringType()), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in slices(batches, "text", 2 << 20):
            rows = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("class").to_pylist(), strict=True):
                s = shingles(text, k, hashes)
                if _class(s) == wanted:
                    rows.append((wanted, len(s), s.tobytes()))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(kind.names)}, pa.schema(
                [("class", pa.string()), ("n", pa.int64()), ("set", pa.binary())]))

    found = docs.join(wanted.withColumnRenamed("key", "wanted_key"), F.col("key").eqNullSafe(F.col("wanted_key"))).select("text", "class").mapInArrow(run, kind)
    return staged(found.dropDuplicates(["class"]).withColumn("c", F.monotonically_increasing_id()), "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, c, n, place, own): the prefix shingles of each class that another class has too.

    ``place`` counts from 1 in the class's order, ``own`` is the number of shingles that no other class
    has (they come first).
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, n, s in zip(*(b.column(x).to_pylist() for x in ("c", "n", "set")), strict=True):
                for i in range(0, n, 20_000):
                    part = np.frombuffer(s, "<i8")[i:i + 20_000]
                    yield pa.RecordBatch.from_pydict({"token": part, "c": np.full(len(part), c), "n": np.full(len(part), n)})

    tokens = staged(sets.select("c", "n", "set").mapInArrow(explode, "token long, c long, n long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("c")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return staged(
        tokens.join(shared, "token").select(
            "token", "c", "n", (F.col("n") - F.count("*").over(mine)).alias("own"), F.row_number().over(mine.orderBy("df", "token")).alias("i"))
        .select("token", "c", "n", (F.col("own") + F.col("i")).alias("place"), "own")
        .where(F.col("place") <= length), "prefixes")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= ``percent`` * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(n).to_pylist() for n in ("a", "b", "x", "y"))
            good = []
            for i in range(len(a)):
                u, v = np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "ok": good}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())]))

    left = sets.select(F.col("c").alias("b"), F.col("set").alias("y"))
    right = sets.select(F.col("c").alias("a"), F.col("set").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, ok boolean")


def link_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root): the components of classes under the verified links."""
    posted = prefixes(sets, percent)
    # classes with identical prefix and size form a group, known by its first class
    shape = posted.groupBy("c").agg(F.first("n").alias("n"), F.hash(F.array_sort(F.collect_list("token"))).alias("h1"),
                                    F.xxhash64(F.array_sort(F.collect_list("token"))).alias("h2"))
    first = shape.groupBy("n", "h1", "h2").agg(F.min("c").alias("g"))
    groups = staged(shape.join(first, ["n", "h1", "h2"]).select("g", "c", "n"), "groups")
    heads = posted.join(groups.where("g = c").select("c"), "c", "left_semi").withColumnRenamed("c", "g")
    links = staged(verify(groups.where("g <> c").select(F.col("g").alias("a"), F.col("c").alias("b")), sets, percent), "links")
    done = [links]
    roots = components(links.where("ok"))
    # members that do not link to their group's first class are groups of their own
    alone = staged(groups.where("g <> c").join(links.where("ok").select(F.col("b").alias("c")), "c", "left_anti").select("c"), "alone")
    members = staged(groups.join(alone, "c", "left_anti").select("g", "c").union(alone.select("c", "c")), "members")
    heads = staged(heads.unionByName(posted.join(alone, "c", "left_semi").withColumnRenamed("c", "g")), "heads")
    # at their first common shingle, two similar sets have enough left behind it; and no smaller size fits
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    fits = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & ((100 + percent) * left >= percent * (F.col("n") + F.col("n2")))

    def live(roots: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The posted shingles with the component of their group, and those that lie in several components."""
        now = heads.join(roots.select(F.col("node").alias("g"), "root"), "g", "left").withColumn("root", F.coalesce("root", "g"))
        central = F.struct(F.when(F.lit(number) == 0, F.col("own")).alias("own"), F.hash("g", F.lit(number)).alias("h"), "g", "n", "place", "root")
        spread = now.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(central).alias("f")).where("lo <> hi")
        return now, spread.select("token", "f")

    def settle(roots: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Verify the new pairs and unite what they link; also how many there were."""
        for d in done:
            pairs = pairs.join(d.select("a", "b"), ["a", "b"], "left_anti")
        found = staged(verify(staged(pairs, "pairs"), sets, percent), "links")
        done.append(found)
        n = found.agg(F.count("*"), F.count_if("ok")).first()
        if n[1]:
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found.where("ok").select("a", "b")))
        return roots, n[0]

    for number in range(STAR_ROUNDS):
        now, spread = live(roots, number)
        roots, new = settle(roots, now.join(spread, "token").select(
            F.least("g", F.col("f.g")).alias("a"), F.greatest("g", F.col("f.g")).alias("b"), "n", F.col("f.n").alias("n2"),
            "place", F.col("f.place").alias("place2"), "root", F.col("f.root").alias("root2")
        ).where(fits & (F.col("root") != F.col("root2"))).select("a", "b").distinct())
        if not new:
            break
    now, spread = live(roots, STAR_ROUNDS)
    now = staged(now.join(spread.select("token"), "token", "left_semi"), "rest")
    other = now.select("token", *(F.col(c).alias(f"{c}2") for c in ("g", "n", "place", "root")))
    across = fits & (F.col("g") < F.col("g2")) & (F.col("root") != F.col("root2"))
    pairs = now.join(other, "token").where(across).select("g", "g2").distinct()
    whole = pairs.join(members.toDF("g", "x"), "g").join(members.toDF("g2", "y"), "g2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return settle(roots, whole)[0]


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest key reachable by links) of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    info = staged(shared_counts(rows, k), "shared")
    may = (F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))
    classes = info.where(may).groupBy("class").agg(F.min("key").alias("key"))
    sets = class_sets(rows, classes, k)
    roots = link_classes(sets, percent)
    root_of = staged(sets.select("class", "c").join(roots.withColumnRenamed("node", "c"), "c", "left").select("class", F.coalesce("root", "c").alias("root")), "roots")
    names = classes.join(root_of, "class").groupBy("root").agg(F.min("key").alias("component_id"))
    linked = info.where(may).join(root_of, "class").join(names, "root").select("key", "n", "component_id")
    single = info.where(~may).select("key", "n", F.col("key").alias("component_id"))
    return linked.union(single).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


@query("op8_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(d, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, c.r FROM c JOIN e ON c.d = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.r) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.d = w.doc_id GROUP BY w.doc_id""")
def op8_ngram_jaccard(spark, sf):
    return similar_components(table(spark, sf, "documents"))
