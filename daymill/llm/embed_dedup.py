"""Near-duplicate embeddings by sorted projection passes.

Each pass gives a vector a key of concatenated random hashes (signs of random projections, the
same for equal vectors) and sorts by it.  The sort is a range partitioning into buckets; blocks of
``bucket`` neighbours in it are compared in full, each also with the ``window`` vectors behind it.
Verified pairs are united across passes.  Every other pass takes the signs around a vector drawn
from the table, so that the members of a family of alike vectors also get different keys.

A pair that a border parts can only be found in another pass.  So passes go on, ``quiet`` at a time,
until that many in a row unite nothing new; how many that takes follows from the table.

Equal vectors are one class from the start, with a count, so copies are never paired.  The links of
each component that the passes found are then counted in full: its vectors are cut into tiles and
every pair of tiles is compared as one matrix product, whatever the component's size.

Rows: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors
of different lengths; null ids are allowed (a component's id is its smallest id that is not null);
repeated rows are vectors of their own; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, table
from daymill.llm.components import components
from daymill.session import staged


@dataclass(frozen=True)
class Passes:
    """``bits`` signs make a key; at least ``passes`` passes are made, and the last ``quiet`` of all unite nothing new."""

    passes: int = 16
    quiet: int = 8
    bits: int = 40
    window: int = 32
    bucket: int = 2000
    tile: int = 2048
    seed: int = 11


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        names, vectors = [], []
        for v in b.column("vector").to_pylist():
            x = np.array(v, np.float64) if v and None not in v else None
            good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
            data = (x + 0.0).astype("<f8").tobytes() if good else None
            names.append(xxhash.xxh3_128_hexdigest(data) if good else None)
            vectors.append(data)
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(names, pa.string()), pa.array(vectors, pa.binary())], names=["key", "class", "vector"])


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(v, "<f8") for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parts(linked: np.ndarray) -> Iterator[np.ndarray]:
    """Members of each component of at least two in a symmetric matrix with an empty diagonal."""
    left = linked.any(axis=1)
    for i in np.flatnonzero(left):
        if left[i]:
            members = [np.array([i])]
            left[i] = False
            while len(members[-1]):
                members.append(np.flatnonzero(linked[members[-1]].any(axis=0) & left))
                left[members[-1]] = False
            yield np.concatenate(members)


def _keyed(classes: DataFrame, sizes: dict[int, int], how: Passes, least: float, passes: range) -> DataFrame:
    """Edges (a, b) that tie the vectors which ``passes`` found alike, a spanning set per block."""
    fields = "pass int, size int, key long, c long, vector binary"
    drawn = [F.min_by("vector", F.xxhash64("class", F.lit(p))).alias(f"p{p}") for p in passes if p % 2]
    centres = {r["size"]: _unit(list(r[1:])) for r in classes.groupBy((F.length("vector") / 8).cast("int").alias("size")).agg(*drawn).collect()}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        weights = 1 << np.arange(how.bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            c, vectors = b.column("c").to_numpy(), b.column("vector").to_pylist()
            sizes = np.array([len(v) // 8 for v in vectors])
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                x = _unit([vectors[i] for i in mine])
                if size not in planes:
                    planes[size] = [np.random.default_rng([how.seed, size, p]).standard_normal((size, how.bits)) for p in passes]
                # equal keys are told apart by class, so a bucket's border can fall between them
                tie = (c[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 + how.bits - 62)).astype(np.int64)
                for k, p in enumerate(passes):
                    moved = x - centres[size][k // 2] if p % 2 else x
                    key = ((moved @ planes[size][k] > 0) @ weights << (62 - how.bits)) | tie
                    yield pa.RecordBatch.from_pydict({
                        "pass": pa.array([p] * len(mine), pa.int32()), "size": pa.array([size] * len(mine), pa.int32()), "key": key, "c": c[mine],
                        "vector": [vectors[i] for i in mine]}, pa.schema([
                            ("pass", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("c", pa.int64()), ("vector", pa.binary())]))

    rows = classes.select("c", "vector").mapInArrow(keys, fields)
    most = max(1, min(4096, max(sizes.values(), default=0) // how.bucket))
    shares = [i / most for i in range(1, most)]
    bounds: dict[tuple[int, int], np.ndarray] = {}
    if shares:
        for r in rows.groupBy("pass", "size").agg(F.percentile_approx("key", shares, 4 * max(2500, most)).alias("p")).collect():
            few = max(1, min(most, sizes[r["size"]] // how.bucket))
            bounds[r["pass"], r["size"]] = np.array(sorted(set(r["p"][most // few - 1::most // few] if few > 1 else [])), np.int64)
    shared = classes.sparkSession.sparkContext.broadcast(bounds)  # at most 4096 keys a pass and length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, s, key = (b.column(n).to_numpy() for n in ("pass", "size", "key"))
            at = np.zeros(len(p), np.int32)
            for one in {*zip(p.tolist(), s.tolist())}:
                mine = (p == one[0]) & (s == one[1])
                at[mine] = np.searchsorted(shared.value.get(one, np.zeros(0, np.int64)), key[mine], "right")
            yield b.append_column("bucket", pa.array(at))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        c, x = t["c"].to_numpy(), _unit(t["vector"].to_pylist())
        a, b = [], []
        for start in range(0, len(c), how.bucket):
            block = slice(start, start + how.bucket + how.window)
            linked = x[block] @ x[block].T >= least
            np.fill_diagonal(linked, False)
            for members in _parts(linked):
                a += [c[start + members[0]]] * (len(members) - 1)
                b += c[start + members[1:]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(place, fields + ", bucket int").groupBy("pass", "size", "bucket").applyInArrow(compare, "a long, b long")


def _united(classes: DataFrame, how: Passes, least: float) -> DataFrame:
    """(node, root) of the classes that the passes found alike."""
    sizes = {r["size"]: r["count"] for r in classes.groupBy((F.length("vector") / 8).cast("int").alias("size")).count().collect()}
    roots, unions, done = None, 0, 0
    while True:
        edges = _keyed(classes, sizes, how, least, range(done, done + how.quiet))
        roots = components(edges if roots is None else edges.union(roots.select("root", "node")))
        before, unions, done = unions, roots.where("node <> root").count(), done + how.quiet
        if done >= how.passes and unions == before:
            return roots


def _count_links(members: DataFrame, how: Passes, least: float) -> DataFrame:
    """(c, links): vectors linked to each class, from all pairs of each component (root, c, copies, vector)."""
    size = members.groupBy("root").agg(F.ceil(F.count("*") / how.tile).cast("int").alias("tiles"))
    rows = members.join(size, "root").withColumn("t", F.pmod(F.hash("c"), F.col("tiles")))
    pair = F.struct(F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("pair", pair)
    # small components share groups
    place = F.when(F.col("tiles") == 1, F.pmod(F.hash("root"), F.lit(4096)).cast("long")).otherwise(-1 - F.col("root"))

    def count(t: pa.Table) -> pa.Table:
        roots, c, tile, copies = (t[n].to_numpy() for n in ("root", "c", "t", "copies"))
        vectors, own = t["vector"].to_pylist(), t["i"][0].as_py()
        across, out = t["i"][0].as_py() != t["j"][0].as_py(), np.zeros(len(c), np.int64)
        order = np.argsort(roots, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            x = _unit([vectors[i] for i in mine])
            parts = (mine[tile[mine] == own], mine[tile[mine] != own]) if across else (mine, mine)
            at = {i: k for k, i in enumerate(mine.tolist())}
            left, right = ([at[i] for i in p.tolist()] for p in parts)
            linked = x[left] @ x[right].T >= least
            out[parts[0]] += linked @ copies[parts[1]]
            if across:
                out[parts[1]] += copies[parts[0]] @ linked
            else:
                out[mine] -= copies[mine] * linked.diagonal()
        return pa.table({"c": c, "links": out})

    return rows.select("root", "c", "t", "copies", "vector", "pair.i", "pair.j", place.alias("place")).groupBy("place", "i", "j").applyInArrow(
        count, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, how: Passes = Passes()) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of each row, for cosines of at least ``least``."""
    kind = vectors.schema[key].dataType
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(_classes, T.StructType([
        T.StructField("key", kind), T.StructField("class", T.StringType()), T.StructField("vector", T.BinaryType())]))
    rows = staged(rows, "vectors")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.count("*").alias("copies"), F.min("key").alias("first"), F.any_value("vector").alias("vector"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    roots = _united(classes, how, least)
    members = classes.join(roots.withColumnRenamed("node", "c"), "c")
    links = _count_links(members.select("root", "c", "copies", "vector"), how, least)
    known = staged(classes.join(roots.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left").select(
        "class", "first", F.coalesce("root", "c").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = rows.where("class is not null").select("key", "class").join(known.join(names, "root").select("class", "n_links", "component_id"), "class")
    alone = rows.where("class is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = linked.select("key", "n_links", "component_id").union(alone)
    return both.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op9_projection_passes", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(d, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, c.r FROM c JOIN e ON c.d = e.a)
SELECT d AS vec_id, (SELECT count(*) FROM e WHERE e.a = d) AS n_links, min(r) AS component_id, min(r) = d AS kept FROM c GROUP BY d""")
def op9_projection_passes(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"))
