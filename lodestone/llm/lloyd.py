"""Centroid clustering: plain Lloyd rounds on integer vectors.

Each round broadcasts the centroids (k times the width, whatever the data), and
every task takes its vectors' integer squared differences to each of them in
numpy. What a task hands on is one sum and one count for each centroid and
component; a grouping merges these, and the new centroids are exact floors of
quotients. The vectors themselves are never shuffled, written or collected:
each round reads two columns of the table again, so a lost executor costs its
tasks only.

Defined results: vectors that are null, of another width, or have a null or
non-finite component are left out, and get no row. Repeated rows are vectors of
their own. A null id comes last in the order of first centroids; rows of one id
are ordered by their components there. With fewer vectors than centroids, each
vector is one. An empty table gives an empty result. Only the two named columns
are read, so others may have any name. Scaled components of 2**27 and more are
an error, as their squared distances need not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the query's contract.
WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Beyond this, a sum of ``WIDTH`` squared differences could pass 2**63.
LARGEST = 1 << 27


def whole(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def scaled(vectors: pd.Series, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors are whole, and these as integers floor(scale * x)."""
    fits = np.fromiter((v is not None and len(v) == width for v in vectors), bool, len(vectors))
    numbers = np.array(list(vectors[fits]), np.float64).reshape(-1, width)  # a null is not a number
    finite = np.isfinite(numbers).all(axis=1)
    fits[fits] = finite
    numbers = np.floor(scale * numbers[finite])
    if numbers.size and np.abs(numbers).max() >= LARGEST:
        raise ValueError(f"a component is too large: scaled, it must be below {LARGEST}")
    return fits, numbers.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the smaller one of a tie, and the squared distance."""
    distances = np.empty((len(vectors), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        apart = vectors - centroid
        distances[:, k] = np.einsum("ij,ij->i", apart, apart)
    at = distances.argmin(axis=1) if len(centroids) else np.zeros(0, np.int64)
    return at, distances[np.arange(len(at)), at]


class Lloyd:
    """Clusters of the vectors in one column of ``df``; ``id`` names them."""

    def __init__(self, df: DataFrame, id: str, vector: str, width: int = WIDTH, scale: int = SCALE):
        self.kind = df.schema[id].dataType
        # ids travel as strings: pandas would make floats of integers among which there are nulls
        self.rows = df.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        self.id, self.width, self.scale = id, width, scale

    def first(self, clusters: int, seed: int) -> np.ndarray:
        """The vectors whose ids have the smallest hashes."""
        by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"), 256)
        best = self.rows.where(whole(F.col("vector"), self.width)).orderBy(by.asc_nulls_last(), "vector").limit(clusters)
        return scaled(best.toPandas()["vector"], self.width, self.scale)[1]

    def _totals(self, centroids: np.ndarray) -> DataFrame:
        """(cluster, component, total, n, distance) of each task's vectors; component -1 has their number and distances."""
        width, scale, shared = self.width, self.scale, self.rows.sparkSession.sparkContext.broadcast(centroids)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = shared.value
            totals, n, spread = np.zeros_like(near), np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
            for frame in frames:
                _, vectors = scaled(frame["vector"], width, scale)
                at, distances = nearest(vectors, near)
                for k in range(len(near)):
                    own = at == k
                    totals[k] += vectors[own].sum(axis=0)
                    n[k] += own.sum()
                    spread[k] += distances[own].sum()
            for k in np.flatnonzero(n):
                yield pd.DataFrame({"cluster": k, "component": np.arange(-1, width), "total": np.concatenate([spread[k : k + 1], totals[k]]), "n": n[k]})

        return self.rows.mapInPandas(sums, "cluster int, component int, total long, n long")

    def sums(self, centroids: np.ndarray) -> tuple[dict[int, list[int]], dict[int, tuple[int, int]]]:
        """For each cluster that has any vectors the sums of their components, and their number and distances."""
        # one number for each centroid and component comes to the driver
        merged = self._totals(centroids).groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("cluster", "component").collect()
        totals: dict[int, list[int]] = {}
        spread: dict[int, tuple[int, int]] = {}
        for r in merged:
            if r.component < 0:
                spread[r.cluster] = (r.n, r.total)
            else:
                totals.setdefault(r.cluster, []).append(r.total)
        return totals, spread

    def moved(self, centroids: np.ndarray) -> np.ndarray:
        """The centroids after a round; those without vectors stay."""
        totals, spread = self.sums(centroids)
        out = centroids.copy()
        for k, own in totals.items():
            out[k] = [x // spread[k][0] for x in own]
        return out

    def fit(self, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
        centroids = self.first(clusters, seed)
        for _ in range(rounds):
            after = self.moved(centroids)
            if np.array_equal(after, centroids):  # every further round would give the same
                break
            centroids = after
        return centroids

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
        _, spread = self.sums(centroids)
        own = np.array([spread.get(k, (0, 0))[1] for k in range(len(centroids))], np.int64)
        names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)
        width, scale, shared = self.width, self.scale, self.rows.sparkSession.sparkContext.broadcast((centroids, own, names))

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near, inertia, hashes = shared.value
            for frame in frames:
                fits, vectors = scaled(frame["vector"], width, scale)
                at, distances = nearest(vectors, near)
                yield pd.DataFrame({"id": frame["id"][fits].array, "cluster": at, "distance": distances, "cluster_inertia": inertia[at], "inertia": inertia.sum(), "centroid_sha256": hashes[at]})

        kinds = (T.StringType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.StringType())
        names_of = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        out = self.rows.mapInPandas(assign, T.StructType(list(map(T.StructField, names_of, kinds))))
        return out.select(F.col("id").cast(self.kind).alias(self.id), *names_of[1:])


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds."""
    vectors = Lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return vectors.assigned(vectors.fit())


def _round_sql(n: int) -> str:
    """The assignment to the centroids of round ``n``, and those of the next."""
    return f"""
  a{n} AS MATERIALIZED (
    SELECT vec_id, c, d FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM parts JOIN c{n} USING (j) GROUP BY vec_id, c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
  ), c{n + 1} AS MATERIALIZED (
    SELECT o.c, o.j, coalesce(w.m, o.m) AS m FROM c{n} o
    LEFT JOIN (SELECT c, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
               FROM parts JOIN a{n} USING (vec_id) GROUP BY c, j) w ON o.c = w.c AND o.j = w.j
  )"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}
  ), parts AS MATERIALIZED (SELECT vec_id, unnest(range({WIDTH})) AS j, unnest(v) AS x FROM kept),
  c0 AS MATERIALIZED (
    SELECT c, unnest(range({WIDTH})) AS j, unnest(v) AS m
    FROM (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {CLUSTERS})
  ), {",".join(map(_round_sql, range(ROUNDS)))},
  last AS MATERIALIZED (
    SELECT vec_id, c, d FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM parts JOIN c{ROUNDS} USING (j) GROUP BY vec_id, c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
  ), names AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM last JOIN names USING (c)
"""
