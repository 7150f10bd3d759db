"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership pattern; a flow routes
each pattern's words to the quotas of its sources, where each further repetition of a pattern
costs more than the one before.  A pattern's documents stand in a seeded order; what the flow
takes from it is a stretch of that order, repeated, so every document knows from its own place
how often and for which source it is taken.  Places are never computed for all documents: a cut
of the stretch is found through sums of hash ranges and turned into the key of one document.

Rows: a null or empty text has size 0; null sources count as one source, ordered last; rows equal in all
columns are taken together; an empty table gives an empty table.
Columns are kept; a column of the name of a result gives way to it.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, table
from daymill.session import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns are statistics of the driver; more than these are refused.
MOST_PATTERNS = 10_000


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code point order; together they get ``share`` of all words."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    seed: int = 17


def targets(sizes: dict[str | None, int], mix: Mix, total: int | None = None) -> dict[str | None, float]:
    """Words per source: by weight, at most ``repeats`` times its size, the excess shared by weight again.

    ``total`` has all words once, where sources overlap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    left, rest = mix.share * (sum(sizes.values()) if total is None else total), sum(weight.values())
    full, level = 0, float("inf")
    for s in sorted(order, key=lambda s: (mix.repeats * sizes[s] / weight[s], order.index(s))):
        level = (left - full) / rest
        if mix.repeats * sizes[s] >= level * weight[s]:
            break
        full += mix.repeats * sizes[s]
        rest -= weight[s]
        level = float("inf")
    return {s: min(float(mix.repeats * sizes[s]), level * weight[s]) for s in order}


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int) -> list[dict]:
    """Words of each pattern (sources, size) for each of its sources; the k-th repetition costs k a word."""
    group = {s: s for s in quotas}

    def find(s):
        while group[s] != s:
            s = group[s] = group[group[s]]
        return s

    for sources, _ in patterns:
        for s in sources[1:]:
            group[find(s)] = find(sources[0])
    parts = defaultdict(list)
    for i, (sources, _) in enumerate(patterns):
        if sources:
            parts[find(sources[0])].append(i)
    out: list[dict] = [{} for _ in patterns]
    for members in parts.values():
        for i, s, words in _flow(patterns, members, quotas, repeats):
            out[i][s] = words
    return out


def _flow(patterns, members, quotas, repeats):
    """Successive cheapest paths over one connected part."""
    ends, room, cost, at = [], [], [], defaultdict(list)

    def edge(a, b, capacity, price):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            at[x].append(len(ends))
            ends.append(y)
            room.append(c)
            cost.append(p)

    lanes = []
    for i in members:
        sources, size = patterns[i]
        for k in range(repeats):
            edge("in", ("p", i), size, k)
        for s in sources:
            lanes.append((i, s, len(ends)))
            edge(("p", i), ("s", s), repeats * size, 0)
    for s in {s for i in members for s in patterns[i][0]}:
        edge(("s", s), "out", quotas[s], 0)
    while True:
        far, by, todo = {"in": 0}, {}, deque(["in"])
        while todo:
            x = todo.popleft()
            for e in at[x]:
                y, d = ends[e], far[x] + cost[e]
                if room[e] > 0 and d < far.get(y, float("inf")):
                    far[y], by[y] = d, e
                    todo.append(y)
        if "out" not in by:
            break
        path, y = [], "out"
        while y != "in":
            path.append(by[y])
            y = ends[by[y] ^ 1]
        words = min(room[e] for e in path)
        for e in path:
            room[e] -= words
            room[e ^ 1] += words
    return [(i, s, room[e ^ 1]) for i, s, e in lanes if room[e ^ 1]]


def mix_sources(docs: DataFrame, sources: Column, size: Column, mix: Mix = Mix(), key: str = "doc_id") -> DataFrame:
    """Add ``size``, ``copies`` (the source that each taken copy serves) and ``source_stats`` (an array of
    (source, source_size, target) of the document's sources).

    ``sources`` is an array (null: one null source), ``size`` a number of words.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    place = T.StructType([T.StructField("h", T.StringType()), T.StructField("k", kind), T.StructField("n", T.LongType()), T.StructField("t", T.LongType())])
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), size.alias("size"), F.col(key).alias("k"),
        F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))).alias("sources"))
    seeded = F.md5(F.encode(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), "UTF-8"))
    rows = rows.select("row", "size", "sources", F.to_json("sources").alias("pattern"),
                       F.struct(seeded.alias("h"), "k", F.col("size").alias("n"), F.xxhash64("row").alias("t")).alias("place"))
    narrow = staged(rows.select("pattern", "place", "sources"), "mix")
    stats = narrow.groupBy("pattern").agg(F.first("sources").alias("s"), F.sum("place.n").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(stats) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sizes: dict = defaultdict(int)
    for r in stats:
        for s in r["s"]:
            sizes[s] += r["n"]
    wanted = targets(sizes, mix, sum(r["n"] for r in stats if r["s"]))
    quotas = {s: int(t + 0.5) for s, t in wanted.items()}
    taken = route([(tuple(r["s"]), r["n"]) for r in stats], quotas, mix.repeats)
    stretches = []  # pattern, repetition, from, to, source: places within a repetition
    for r, flow in zip(stats, taken, strict=True):
        x = 0
        for s in sorted(flow, key=lambda s: (s is None, s or "")):
            end = x + flow[s]
            while x < end:
                lap = x // r["n"]
                stop = min(end, (lap + 1) * r["n"])
                stretches.append((r["pattern"], x - lap * r["n"], stop - lap * r["n"], s))
                x = stop
    whole = {r["pattern"]: r["n"] for r in stats}
    cuts = sorted({(p, x) for p, a, b, _ in stretches for x in (a, b) if 0 < x < whole[p]})
    keys = {(r["pattern"], r["x"]): r["at"] for r in _cut_keys(narrow, cuts).collect()} if cuts else {}
    by_pattern = defaultdict(list)
    for p, a, b, s in stretches:
        by_pattern[p].append((keys.get((p, a)), keys.get((p, b)), s))
    schema = T.StructType([
        T.StructField("pattern", T.StringType()),
        T.StructField("stretches", T.ArrayType(T.StructType([T.StructField("lo", place), T.StructField("hi", place), T.StructField("source", T.StringType())]))),
        T.StructField("stats", T.ArrayType(T.StructType([
            T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])))])
    plan = spark.createDataFrame([
        (r["pattern"], by_pattern.get(r["pattern"], []), [(s, sizes[s], wanted[s]) for s in r["s"]]) for r in stats], schema)
    inside = lambda x: (x["lo"].isNull() | (F.col("place") >= x["lo"])) & (x["hi"].isNull() | (F.col("place") < x["hi"]))
    copies = F.transform(F.filter("stretches", inside), lambda x: x["source"])
    names = [c for c in docs.columns if c.lower() not in ("size", "copies", "source_stats")]
    return rows.join(F.broadcast(plan), "pattern").select(
        *(F.col(f"row.`{c}`") for c in names), "size", copies.alias("copies"), F.col("stats").alias("source_stats"))


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cut_keys(narrow: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """For each (pattern, words): the first document whose middle lies at or after so many words."""
    spark = narrow.sparkSession
    cut = spark.createDataFrame(cuts, "pattern string, x long")
    bucket = F.substring("place.h", 1, 3)
    sums = narrow.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("place.n").alias("n"))
    order = Window.partitionBy("pattern").orderBy("bucket")
    sums = sums.select("pattern", "bucket", F.sum("n").over(order).alias("end"), (F.sum("n").over(order) - F.col("n")).alias("base"))
    # the cut lies in the first range that reaches it, or at the start of the next
    near = sums.join(F.broadcast(cut), "pattern").where(F.col("end") >= F.col("x")).withColumn(
        "i", F.row_number().over(Window.partitionBy("pattern", "x").orderBy("bucket"))).where("i <= 2").drop("i", "end")
    held = narrow.select("pattern", "place", bucket.alias("bucket")).join(near, ["pattern", "bucket"])
    inner = Window.partitionBy("pattern", "x", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("base") + F.sum("place.n").over(inner)) - F.col("place.n")
    return held.withColumn("middle", middle).where(F.col("middle") >= 2 * F.col("x")).groupBy("pattern", "x").agg(F.min("place").alias("at"))


_OP4 = r"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
r AS (SELECT *, coalesce(sum(2 * total) OVER (ORDER BY 2 * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER (ORDER BY 2 * total / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    (SELECT 1.5::DOUBLE * sum(total)::DOUBLE FROM s) AS goal FROM s),
level AS (SELECT coalesce(arg_min((goal - full_::DOUBLE) / rest::DOUBLE, (2 * total / w, source IS NULL, source))
    FILTER (2 * total >= (goal - full_::DOUBLE) / rest::DOUBLE * w), 'inf'::DOUBLE) AS v FROM r),
g AS (SELECT source, total, least(2.0::DOUBLE * total, level.v * w) AS target FROM s, level),
m AS (SELECT d.*, g.total, g.target, floor(g.target + 0.5)::BIGINT AS quota,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)"""


@query("op4_source_mix", f"""WITH {_OP4}
SELECT doc_id, size, total AS source_size, target,
  (size * ((2 * before + size < 2 * quota)::BIGINT + (2 * (before + total) + size < 2 * quota)::BIGINT))::BIGINT AS taken FROM m""")
def op4_source_mix(spark, sf):
    docs = staged(table(spark, sf, "documents").select("doc_id", "source", words("text").alias("size")), "sizes")
    stat = F.col("source_stats")[0]
    return mix_sources(docs, F.array("source"), F.col("size")).select(
        "doc_id", "size", stat["source_size"].alias("source_size"), stat["target"].alias("target"),
        (F.col("size") * F.size("copies")).alias("taken"))
