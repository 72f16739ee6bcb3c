"""Centroid clustering over integer vectors: exact rounds of nearest centroids, found by annulus search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches, table

#: Bounds are widened by this share, far above the rounding of a square root, so that ties at an annulus' boundary are inside.
_SLACK = 1e-9


class Annulus:
    """Centroids sorted by norm. By the triangle inequality a centroid within u of x has a norm within u of the norm of x."""

    def __init__(self, centres: np.ndarray) -> None:
        norms = np.sqrt((centres.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centres = norms[self.number], centres[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x (integers) the nearest centroid's number (ties: the smallest) and the exact squared distance.

        The upper bound is the distance to the nearer of the two centroids next in norm. Only those with norms in the annulus that
        it spans, a slice of the sorted norms found by binary search, are compared.
        """
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        at = np.searchsorted(self.norms, norm)
        bound = np.full(n, np.iinfo(np.int64).max)
        for near in (np.minimum(at, k - 1), np.maximum(at - 1, 0)):
            bound = np.minimum(bound, ((x - self.centres[near]) ** 2).sum(axis=1))
        reach = np.sqrt(bound.astype(np.float64))
        reach += _SLACK * (reach + norm + 1.0)
        low = np.searchsorted(self.norms, norm - reach, "left")
        high = np.searchsorted(self.norms, norm + reach, "right")
        best, chosen = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
        for j in range(int(low.min(initial=k)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= j) & (j < high))
            d, number = ((x[rows] - self.centres[j]) ** 2).sum(axis=1), self.number[j]
            better = (d < best[rows]) | ((d == best[rows]) & (number < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = d[better], number
        return chosen.astype(np.int32), best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """_id and _v, array of the integers floor(scale * x), of the rows whose vector has `size` components, none null or non-finite.

    Squared distances are held in 64 bits; a component beyond sqrt(2^63 / size) / 2 (1.9e8 for 64) is an error.
    """
    x = F.col(vector_col)
    fit = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v.cast("double")), F.lit(False)))
    most = int(math.isqrt((2**63 - 1) // size) // 2)

    def whole(v):
        scaled = F.floor(v.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(scaled) <= most, scaled).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {most}"))).cast("long")

    return df.filter(F.coalesce(fit, F.lit(False))).select(F.col(id_col).alias("_id"), F.transform(x, whole).alias("_v"))


def first_centroids(kept: DataFrame, k: int, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order; equal ids by their vectors, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    rows = kept.select(key.alias("_key"), "_v").orderBy(F.col("_key").asc_nulls_last(), "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64)


def cluster_sums(kept: DataFrame, centres: np.ndarray) -> DataFrame:
    """cluster, place, total: each component's sum over the cluster's vectors, and at place -1 their number.

    Each task adds up its vectors first, so that a round shuffles at most k rows of sums a task, whatever the sizes of clusters.
    """
    size, k = centres.shape[1], len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus, sums, counts = Annulus(centres), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            chosen, _ = annulus.nearest(x)
            counts += np.bincount(chosen, minlength=k)
            for c in np.unique(chosen):
                sums[c] += x[chosen == c].sum(axis=0)
        some = np.flatnonzero(counts)
        rows = np.column_stack((counts[some], sums[some]))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = kept.select("_v").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("place", "part"))
    return parts.groupBy("cluster", (F.col("place") - 1).alias("place")).agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def fit_centroids(kept: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """The centroids after `rounds` rounds; the driver gets k rows of sums a round. Fewer vectors than k give as many centroids."""
    centres = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centres) else 0):
        found: dict[int, dict[int, int]] = {}
        for r in cluster_sums(kept, centres).collect():
            found.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
        for c, sums in found.items():
            centres[c] = [sums[i] // sums[-1] for i in range(centres.shape[1])]  # exact floor
    return centres


def assign(kept: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    kind = kept.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centres)
        for batch in batches:
            chosen, distance = annulus.nearest(_matrix(batch.column(1), centres.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return kept.select("_id", "_v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its integers) of each row that has a whole vector.

    Rows whose vector is null, of another size, or has a null or non-finite component are left out. Rows that repeat an id, null
    too, are vectors each; equal vectors have equal clusters. An empty table, or one without whole vectors, gives no rows. Other
    columns are ignored, whatever their names.
    """
    small_batches(df.sparkSession)
    kept = cut(integer_vectors(df, id_col, vector_col, size, scale))  # read in every round
    centres = fit_centroids(kept, k, rounds, seed)
    if not len(centres):
        kind = kept.schema["_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    found = cut(assign(kept, centres))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), centres[c].tolist()) for c, s in sums.items()]
    named = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Every whole vector of embeddings in one of 8 clusters after 10 rounds."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sha = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))


def _sql(size: int = 64, k: int = 8, rounds: int = 10) -> str:
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
             f"""c0 AS MATERIALIZED (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept) WHERE c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT kept.r, c{i}.c, CAST(list_sum(list_transform(range(1, {size + 1}), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS BIGINT) AS d FROM kept CROSS JOIN c{i})
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT a{i}.best.c AS c, i, sum(kept.v[i]) AS s, count(*) AS n FROM kept JOIN a{i} USING (r) CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY ALL)
    GROUP BY c) AS m USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.c = best.c"""


OP12_SQL = _sql()
