"""Centroid clustering on built-in expressions with exact integer arithmetic.

Components become the integers ``floor(scale * x)``.  Centroids start as the ``k`` vectors with the
smallest seeded hashes of their ids.  Each round finds the nearest centroid of every row by
``zip_with`` and ``aggregate`` against literal arrays, ``array_min`` of (distance, number) structs
settling ties, and then sums every component per cluster; only ``k`` rows of sums reach the driver,
which divides them.  A round is one scan of narrow rows and one shuffle of ``k`` rows a task, so
neither a cluster nor a copied vector with most of the rows gathers anywhere.

Rows: vectors that are null, of another length, or hold null or non-finite components are left out;
equal vectors and rows that repeat an id are rows of their own and get equal clusters.  A null id
hashes as the empty text.  Equal hashes (repeated ids) start in order of their components.  With fewer vectors
than ``k`` there are as many centroids as vectors; an empty table gives an empty table and no centroid.  Integers
beyond ``MOST`` in size count as ``MOST``, so every squared distance fits 64 bits up to 64 dimensions.
Extra columns are kept; columns named ``cluster`` or ``distance`` give way to the results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.llm.base import free_name, query, table
from daymill.session import staged

#: Largest size of an integer component.
MOST = 1 << 27


def quantised(vector: Column, dims: int, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component as long; null for vectors that are left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bounded = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale)))
    return F.when((F.size(vector) == dims) & ~bad, F.transform(vector, lambda x: bounded(x).cast("long")))


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ties go to the smaller number."""
    def far(c: list[int]) -> Column:
        squares = F.zip_with(q, F.array(*(F.lit(x).cast("long") for x in c)), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, s: total + s)

    return F.array_min(F.array(*(F.struct(far(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))


def first_centroids(rows: DataFrame, id_: str, q: str, k: int, seed: int) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of ``seed:id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256)
    return [list(r[q]) for r in rows.select(h.alias("h"), q).orderBy("h", q).limit(k).collect()]


def moved(rows: DataFrame, q: str, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every non-empty centroid becomes the floored mean of its rows."""
    dims = len(centroids[0])
    sums = [F.sum(F.col(q)[i]).alias(f"s{i}") for i in range(dims)]
    near = rows.select(nearest(F.col(q), centroids)["cluster"].alias("cluster"), q)
    out = list(centroids)
    for r in near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
    seed: int = 1,
) -> tuple[DataFrame, list[list[int]]]:
    """(``vectors`` that are kept, with ``cluster`` int and ``distance`` long; the final centroids)."""
    names = [c for c in vectors.columns if c.lower() not in ("cluster", "distance")]
    q = free_name(vectors, "q")
    rows = staged(vectors.select(*(F.col(f"`{c}`") for c in names), quantised(F.col(f"`{vector}`"), dims, scale).alias(q)).where(
        F.col(q).isNotNull()), "quantised")
    centroids = first_centroids(rows, f"`{key}`", q, k, seed)
    if not centroids:
        return rows.select(*(F.col(f"`{c}`") for c in names), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(rows, q, centroids)
    near = free_name(rows, "near")
    found = rows.withColumn(near, nearest(F.col(q), centroids))
    return found.select(*(F.col(f"`{c}`") for c in names), F.col(f"{near}.cluster").alias("cluster"), F.col(f"{near}.distance").alias("distance")), centroids


def centroid_digest(c: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` (summed distances of the cluster and of all) and ``centroid_sha256``."""
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    each = [sums.get(i, 0) for i in range(len(centroids))] or [0]
    digests = [centroid_digest(c) for c in centroids] or [""]
    return found.withColumns({
        "cluster_inertia": of(each, "long"), "inertia": F.lit(sum(each)).cast("long"), "centroid_sha256": of(digests, "string")})


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """SQL twin: rounds are common tables over (vector, component) rows."""
    parts = ["""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "v AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM kept)",
             f"""c0 AS (SELECT c, unnest(q) AS y, generate_subscripts(q, 1) AS d FROM (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min((s, c)) AS m FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS s
  FROM v JOIN c{r} USING (d) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce(n.y, o.y) AS y FROM c{r} o LEFT JOIN (SELECT m[2] AS c, d,
  ((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS y FROM v JOIN a{r} USING (vec_id) GROUP BY ALL) n USING (c, d))""")
    return f"""WITH {', '.join(parts)},
h AS (SELECT c, sha256(string_agg(y, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, m[2]::INTEGER AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia,
  (sum(m[1]) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h ON h.c = m[2]"""


@query("op13_centroid_clusters", _oracle())
def op13_centroid_clusters(spark, sf):
    found, centroids = cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return with_inertia(staged(found.select("vec_id", "cluster", "distance"), "clusters"), centroids)
