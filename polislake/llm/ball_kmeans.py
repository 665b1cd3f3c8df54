"""Ball k-means: exact Lloyd rounds in which clusters are balls and most distances are never computed.

Vectors are packed once into blocks of whole numbers. In a round a task takes the members of each cluster in a block as a ball: the cluster's centroid, and the largest distance of a
member from it as the radius. A centroid more than twice the radius away is no neighbour. The half distances to the neighbours, in ascending order, split the members into a stable core,
which no neighbour can win, and rings: the members of ring m are compared with the m nearest neighbours, exactly. All arithmetic is on whole numbers, so results do not
depend on how vectors are spread over blocks and tasks.

A block carries the counts and sums of its members by cluster, so the new centroids come from those columns alone: k times dim numbers, summed by Spark, reach the driver. A round's
blocks are written to the shared folder; the round before is deleted then. Rounds after one that moves no centroid change nothing and are left out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release
from ._tokens import pack, unpack

#: Whole components below this, so that four times a squared distance of 64 components is a 64-bit number.
LIMIT = 1 << 26
BLOCK = 4096
STATE = "ids array<bigint>, vectors binary, cluster binary, distance binary, members array<bigint>, totals array<bigint>, inertias array<bigint>"


def whole_vectors(vectors: DataFrame, column: str, key: str, dim: int, scale: int) -> DataFrame:
    """id, q: vectors of `dim` finite components, each floor(scale * x). Others are left out. A component of LIMIT / scale or more ends the job with an error."""
    x = F.col(column)
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where((F.size(x) == dim) & fine)
    small = F.forall("x", lambda e: F.abs(e.cast("double")) * scale < LIMIT)
    problem = F.raise_error(F.lit(f"a component of {LIMIT // scale} or more: squared distances would not fit 64 bits")).cast("array<int>")
    return kept.select("id", F.when(small, F.transform("x", lambda e: F.floor(e.cast("double") * scale).cast("int"))).otherwise(problem).alias("q"))


def _blocks(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                q = part.column(1).flatten().to_numpy().reshape(-1, dim)
                small = next(t for t in (np.int8, np.int16, np.int32) if q.min() >= np.iinfo(t).min and q.max() <= np.iinfo(t).max)
                yield _block([part.column(0).to_pylist(), pack(q.astype(small).ravel()), None, None, None, None, None])

    return run


def _block(values: list) -> pa.RecordBatch:
    lists, binary = pa.list_(pa.int64()), pa.binary()
    kinds = (lists, binary, binary, binary, lists, lists, lists)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in STATE.split(", ")])


def ball_assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were computed. own: any assignment to start from."""
    k = len(centroids)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    nearest, distance, computed = own.copy(), np.zeros(len(x), np.int64), len(x)
    for i in range(k):
        ball = np.flatnonzero(own == i)
        if not len(ball):
            continue
        member = x[ball]
        best, who = ((member - centroids[i]) ** 2).sum(1), np.full(len(ball), i)
        reach = 4 * best  # a centroid farther away than this can neither win nor tie
        near = np.flatnonzero((apart[i] <= reach.max()) & (np.arange(k) != i))
        near = near[np.argsort(apart[i, near], kind="stable")]
        ring = np.searchsorted(apart[i, near], reach, side="right")  # 0: the stable core
        for m, j in enumerate(near):
            out = np.flatnonzero(ring > m)
            d = ((member[out] - centroids[j]) ** 2).sum(1)
            computed += len(out)
            won = (d < best[out]) | ((d == best[out]) & (j < who[out]))
            best[out[won]], who[out[won]] = d[won], j
        nearest[ball], distance[ball] = who, best
    return nearest, distance, computed


def _round(centroids: np.ndarray) -> Callable:
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, vectors, cluster in zip(b.column(0), b.column(1), b.column(2), strict=True):
                x = unpack(vectors.as_py())[0].reshape(-1, dim).astype(np.int64)
                own = unpack(cluster.as_py())[0].astype(np.int64) if cluster.is_valid else np.zeros(len(x), np.int64)
                own, distance, _ = ball_assign(x, own, centroids)
                totals, inertias = np.zeros((k, dim), np.int64), [0] * k
                for i in range(k):
                    totals[i] = x[own == i].sum(0)
                    inertias[i] = int(distance[own == i].sum())
                yield _block([ids.as_py(), vectors.as_py(), pack(own), pack(distance), np.bincount(own, minlength=k).tolist(), totals.ravel().tolist(), inertias])

    return run


def _sums(state: DataFrame, column: str, n: int) -> list[int]:
    """Sums by place, exact at any size."""
    rows = state.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    out = [0] * n
    for at, v in rows:
        out[at] = int(v or Decimal(0))
    return out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, cluster, distance in zip(*b.columns, strict=True):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(unpack(cluster.as_py())[0], pa.int32()), pa.array(unpack(distance.as_py())[0].astype(np.int64))], ["id", "cluster", "distance"])


def ball_kmeans(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, start: Callable[[Column], Column] | None = None) -> DataFrame:
    """`key`, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that whole_vectors keeps.

    Centroids start as the k vectors with the smallest lower-case hex SHA-256 of `3:<id>` (or of what `start` makes of the id), ties by their components, null ids last; fewer vectors
    give fewer centroids. Rows that repeat are vectors each. Null or wrong vectors are left out, an empty table gives an empty result, other columns are not read."""
    whole = whole_vectors(vectors, column, key, dim, scale)
    name = start(F.col("id")) if start else F.concat(F.lit("3:"), F.col("id").cast("string"))
    first = whole.select("q", F.sha2(name, 256).alias("name")).orderBy(F.col("name").asc_nulls_last(), "q").limit(k).collect()
    end = "id bigint, cluster int, distance bigint"
    if not first:
        none = whole.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
        return none.where("false").withColumnRenamed("id", key)
    centroids = np.array([r["q"] for r in first], np.int64)
    k = len(centroids)
    state = materialize(whole.mapInArrow(_blocks(dim), STATE), "vectors")
    for r in range(rounds + 1):
        after = materialize(state.mapInArrow(_round(centroids), STATE), "vectors")
        release(state)
        state = after
        if r == rounds:
            break
        members, totals = _sums(state, "members", k), _sums(state, "totals", k * dim)
        moved = np.array([[t // members[i] for t in totals[i * dim : (i + 1) * dim]] if members[i] else centroids[i].tolist() for i in range(k)], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    inertias = _sums(state, "inertias", k)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = vectors.sparkSession.createDataFrame([(i, inertias[i], sum(inertias), digests[i]) for i in range(k)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = state.select("ids", "cluster", "distance").mapInArrow(_members, end)
    return rows.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """The same by all distances."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dim} "
        "AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    distance = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))".format(d=dim)
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.q, c, c.q AS m, CAST({distance} AS BIGINT) AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"u{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i)")
            parts.append(f"w{r} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS q FROM u{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(w{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN w{r} USING (c))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds}"
    )


ORACLE_SQL = oracle()
