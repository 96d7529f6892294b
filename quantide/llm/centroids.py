"""Centroid clustering by scalar lookup tables.

Components are integers, floor(scale * x), and few values occur in a dimension. So a round needn't multiply: for each
dimension, occurring value and centroid the squared difference is tabulated once, and the distances of a block of vectors are
gathers from these tables and their sums.

Vectors are packed once into blocks: the values that occur in each dimension, and for each vector the places of its
components among them. Blocks lie in the shared folder, so a round reads small integers, and a lost executor costs only its
tasks. A task tabulates for the values of its block, so tables never have more rows than the block has vectors. A
round's sums go to Spark as limbs of 40 bits, added up by position; the driver sees the sums of ``k`` centroids and
nothing that grows with the input. The result joins a table of ``k`` rows, which is broadcast.

Integers are exact at any size: blocks and centroids whose distances may not fit 64 bits are tabulated as Python
integers.

Defined results: vectors of another length, null, or with a null or non-finite component take no part; a null id is
hashed as the empty string; repeated rows are vectors of their own, and where equal ids compete for the first
centroids the smaller vector comes first; with fewer vectors than centroids there are as many centroids as vectors; an empty table
gives an empty result; a distance or sum beyond 64 bits is given as null (the cluster still is exact); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import drop_stored, stored, table

K = 16
ROUNDS = 3
DIM = 64
SCALE = 64
SEED = "1"
#: vectors of a block
BLOCK = 4096
#: bits of the limbs in which sums travel
LIMB = 40
_LONG = 1 << 63


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64 where all fit, else Python integers."""
    with np.errstate(over="ignore"):
        wide = np.floor(x * scale)
    if scale & (scale - 1) == 0 and (not wide.size or np.abs(wide).max() < 1 << 62):
        return wide.astype(np.int64)
    return np.array([math.floor(Fraction(float(v)) * scale) for v in x.ravel()], object).reshape(x.shape)


def _packed(dim: int, scale: int):
    """Blocks of vectors: ids, occurring values by dimension as text, and places of the components, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                vectors = integers(np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim), scale)
                values, places = [], []
                for d in range(dim):
                    occurring, place = np.unique(vectors[:, d], return_inverse=True)
                    values.append([str(v) for v in occurring.tolist()])
                    places.append(place.astype("<u2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), pa.array([values], pa.list_(pa.list_(pa.string()))), pa.array([np.concatenate(places).tobytes()], pa.binary())],
                    names=["ids", "occurring", "places"],
                )

    return run


def distances(occurring: list[list[str]], places: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of a block's vectors from all centroids, by gathers from tables of its occurring values."""
    numbers = [[int(v) for v in values] for values in occurring]
    most = max((abs(v) for values in [*numbers, *centroids] for v in values), default=0)
    kind = np.int64 if len(numbers) * (2 * most) ** 2 < _LONG else object
    c = np.array(centroids, kind)
    total = np.zeros((places.shape[1], len(centroids)), kind)
    for d, values in enumerate(numbers):
        difference = np.array(values, kind)[:, None] - c[None, :, d]
        total += (difference * difference)[places[d]]
    return total


def _assigned(row_ids, occurring, places, centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places by dimension, and each vector's nearest centroid and its distance."""
    at = np.frombuffer(places, "<u2").reshape(len(occurring), -1)
    found = distances(occurring, at, centroids)
    # the first of equal ones is the smaller number
    nearest = found.argmin(1)
    return at, nearest, found[np.arange(len(nearest)), nearest]


def limbs(v: int) -> list[int]:
    """v as digits of 40 bits, the last one signed: they add up without overflow."""
    out = []
    while not -(1 << LIMB) <= v < 1 << LIMB:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _sums(centroids: list[list[int]]):
    """Rows of centroid, position and value: position -1 counts vectors, others are dimension and limb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(centroids), len(centroids[0])
        count, total = np.zeros(k, np.int64), [[0] * dim for _ in range(k)]
        for batch in batches:
            for row in batch.to_pylist():
                at, nearest, _ = _assigned(row["ids"], row["occurring"], row["places"], centroids)
                count += np.bincount(nearest, minlength=k)
                for d, values in enumerate(row["occurring"]):
                    # how often each occurring value stands in each cluster
                    often = np.bincount(nearest * len(values) + at[d], minlength=k * len(values)).reshape(k, -1)
                    for c in range(k):
                        there = np.flatnonzero(often[c])
                        total[c][d] += sum(int(values[i]) * n for i, n in zip(there.tolist(), often[c][there].tolist()))
        rows = [(c, -1, 0, int(count[c])) for c in range(k) if count[c]]
        rows += [(c, d, i, limb) for c in range(k) if count[c] for d in range(dim) for i, limb in enumerate(limbs(total[c][d]))]
        yield pa.RecordBatch.from_pylist([dict(zip(("cluster", "position", "limb", "value"), r)) for r in rows], schema=pa.schema([("cluster", pa.int32()), ("position", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))

    return run


def _placed(centroids: list[list[int]], kind: pa.DataType, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, nearest, distance = _assigned(row["ids"], row["occurring"], row["places"], centroids)
                fits = [x if x < _LONG else None for x in distance.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(nearest, pa.int32()), pa.array(fits, pa.int64())], names=[key, "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    x = F.col("v").cast("array<double>")
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.size("v") == dim).select("id", x.alias("v"))
    kept = kept.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(hashed, "v").limit(k).select("v").collect()
    kind = dict(kept.dtypes)["id"]
    shape = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], shape)
    centroids = [[int(v) for v in row] for row in integers(np.array([r["v"] for r in first]), scale).tolist()]
    blocks = stored(kept.mapInArrow(_packed(dim, scale), f"ids array<{kind}>, occurring array<array<string>>, places binary"), "vectors")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(centroids), "cluster int, position int, limb int, value long").groupBy("cluster", "position", "limb").agg(F.sum("value").alias("value"))
        total: dict[tuple[int, int], int] = {}
        for r in sums.collect():  # k * (dim + 1) numbers
            total[r["cluster"], r["position"]] = total.get((r["cluster"], r["position"]), 0) + (r["value"] << (LIMB * r["limb"]))
        centroids = [[total[c, d] // total[c, -1] for d in range(dim)] if (c, -1) in total else centroids[c] for c in range(len(centroids))]
    arrow = pa.array([], _arrow_type(kept)).type
    placed = stored(blocks.mapInArrow(_placed(centroids, arrow, key), f"`{key}` {kind}, cluster int, distance long"), "assigned")
    drop_stored(blocks)
    whole = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # k rows at most
    by = {r["cluster"]: None if r["lost"] else int(r["sum"]) for r in whole}
    every = None if None in by.values() else sum(by.values())
    fits = lambda v: None if v is None or v >= _LONG else v
    named = [(c, fits(v), fits(every), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in by.items()]
    small = vectors.sparkSession.createDataFrame(named, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(small), F.col("cluster") == F.col("c")).select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _arrow_type(kept: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kept.schema["id"].dataType)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(
            f"""a{r} AS MATERIALIZED (SELECT n, arg_min(c, (distance, c)) AS cluster, min(distance) AS distance FROM (
  SELECT x.n, m.c, sum((x.v - m.v) * (x.v - m.v)) AS distance FROM x JOIN c{r} m USING (d) GROUP BY x.n, m.c) GROUP BY n)"""
        )
        if r < ROUNDS:
            # exact floor of a quotient, for negative sums too
            rounds.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, c.d, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.v)::BIGINT AS v FROM c{r} c LEFT JOIN
  (SELECT cluster, d, sum(v) AS s, count(*) AS n FROM x JOIN a{r} USING (n) GROUP BY ALL) s ON s.cluster = c.c AND s.d = c.d)"""
            )
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, embedding AS v FROM embeddings WHERE len(embedding) = {DIM}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
x AS MATERIALIZED (SELECT n, unnest(range({DIM})) AS d, unnest(list_transform(v, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)) AS v FROM e),
f AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM e QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, d, v FROM x JOIN f USING (n)),
{",".join(rounds)},
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (n) JOIN h ON h.c = cluster
"""


ORACLE = _oracle()
