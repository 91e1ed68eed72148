"""Centroid clustering of vectors with an incremental distance matrix, in exact whole numbers.

Each vector keeps its dot product with every centroid. A round adds, for each centroid, the products
of the components that changed (``dot += sum of x_j * change_j`` over changes other than 0); the squared distance
is ``|x|^2 - 2 dot + |c|^2`` and the least one is taken again. The first round starts from products
of 0 with centroids at the origin, so it runs by the same law. New centroids are floors of exact
means, from sums that Spark adds up per cluster before anything is shuffled.

The matrix of products is a table, written anew each round and read from files; a lost executor repeats
one round at most. Only the two latest are kept, and the driver holds centroids alone (clusters x
components numbers).

Defined results: vectors that are null, have another number of components, or hold a null or
non-finite component are left out. Repeated rows and ids are clustered row by row; a null id counts
as the text ``null`` in the choice of first centroids. With fewer vectors than clusters each vector
starts one. An empty table gives an empty result. Components are cut to +-``LARGEST`` so that all
sums stay within 64 bits. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.session import Scratch, scratch_path

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SALT = "2"
#: Components in units of 1/256 are kept up to this size: 64 squares of differences fit 63 bits.
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dimensions: int, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x) of the vectors that are kept, in whole units of 1/256."""
    infinite = F.lit(float("inf"))

    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)

    units = F.transform(
        F.col("v"),
        lambda x: F.least(
            F.greatest(F.floor(x.cast("double") * 256.0), F.lit(-LARGEST).cast("bigint")),
            F.lit(LARGEST).cast("bigint"),
        ).cast("int"),
    )
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    return rows.filter((F.size("v") == dimensions) & F.forall("v", good)).select(
        "vec_id", units.alias("x")
    )


def first_centroids(points: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """Vectors with the smallest digests of salt and id (a top-k; ties by the components)."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = points.select(F.sha2(name, 256).alias("d"), "x").orderBy("d", "x").limit(clusters)
    return [r["x"] for r in rows.collect()]


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    places = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values.ravel(), type=kind))


def step(changes: np.ndarray, norms: np.ndarray, fresh: bool) -> Callable:
    """Add the products of the changed components, then find each vector's nearest centroid."""
    clusters, width = changes.shape
    changed = [(c, np.flatnonzero(row)) for c, row in enumerate(changes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width, np.int64)
            if fresh:
                dots = np.zeros((len(x), clusters), dtype=np.int64)
            else:
                dots = _matrix(batch.column("dots"), clusters, np.int64).copy()
            for c, places in changed:
                if len(places):
                    dots[:, c] += x[:, places] @ changes[c, places]
            distances = (x * x).sum(axis=1)[:, None] - 2 * dots + norms[None, :]
            nearest = distances.argmin(axis=1)
            yield pa.record_batch(
                [
                    batch.column("vec_id"),
                    _lists(x, pa.int32()),
                    _lists(dots, pa.int64()),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(distances[np.arange(len(x)), nearest]),
                ],
                names=["vec_id", "x", "dots", "cluster", "distance"],
            )

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floors of the means of their vectors; those without vectors stay."""
    sums = [F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(centroids.shape[1])]
    moved_to = centroids.copy()
    # One row per cluster.
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        moved_to[row["cluster"]] = [s // row["n"] for s in row[2:]]
    return moved_to


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    salt: str = SALT,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, dots, cluster, distance) after ``rounds`` moves of the centroids, and these."""
    spark = vectors.sparkSession
    points = whole_vectors(vectors, dimensions, id_col, vector)
    start = first_centroids(points, clusters, salt)
    centroids = np.array(start, dtype=np.int64).reshape(len(start), dimensions)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids
    held = Scratch(spark)
    state, before = points, np.zeros_like(centroids)
    for turn in range(rounds + 1):
        if turn:
            before, centroids = centroids, moved(state, centroids)
        norms = (centroids * centroids).sum(axis=1)
        update = step(centroids - before, norms, fresh=turn == 0)
        held.paths.append(scratch_path(spark, "products"))
        path = held.paths[-1]
        state.mapInArrow(update, STATE).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        held.drop(kept=1)
    return state, centroids


def describe(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with its cluster's sums and the digest of its centroid's components."""
    spark = state.sparkSession
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # One row per cluster: a broadcast of fixed size.
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    rows = [(c, inertia[c], total, names[c]) for c in sorted(inertia)]
    facts = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round_sql(turn: int) -> str:
    """Assignment to the centroids of a round, and the centroids after it."""
    return f"""
dist{turn} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS s
  FROM v JOIN c{turn} AS c USING (j) GROUP BY v.r, c.c),
a{turn} AS (SELECT r, c, s FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s, c) AS k FROM dist{turn}) WHERE k = 1),
c{turn + 1} AS (SELECT o.c, o.j, coalesce(m.x, o.x) AS x FROM c{turn} AS o LEFT JOIN
  (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
   FROM v JOIN a{turn} USING (r) GROUP BY c, j) AS m USING (c, j))"""


CLUSTERED_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, unnest(range({DIMENSIONS})) AS j,
  CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 256) AS BIGINT) AS x FROM e),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SALT}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), embedding) - 1 AS c FROM e),
c0 AS (SELECT f.c, v.j, v.x FROM v JOIN f USING (r) WHERE f.c < {CLUSTERS}),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
n AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance,
  CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia,
  centroid_sha256
FROM e JOIN a{ROUNDS} USING (r) JOIN n USING (c)
"""


@query("op12_incremental_centroids", CLUSTERED_SQL)
def op12_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(*cluster_vectors(table(spark, sf_dir, "embeddings")))
