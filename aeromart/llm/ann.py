"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves, and each half has its own quantiser (k-means
on a bounded sample; more centroids the more rows there are, so cells keep
about ``CELL_ROWS`` rows up to ``MOST_CENTROIDS`` a half).  A row belongs to
the cell of its two nearest centroids.  A query goes through the cells in the
order of the summed closeness of their centroids to its halves (here their
inner products, as that is the measure), taking them off a heap, until the
cells taken hold enough rows; all these rows are reranked by the exact inner
product in double precision.

How many rows are enough is measured, not given: ``share`` of all rows is
the least at which ``recall`` of the near neighbours of sampled queries,
found by brute force in the fitting sample, stand in the cells taken.  As the
sample is thinner than the table, its list of a query is shorter in
proportion.  On the test tables, whose vectors are close to random
directions, about half of the rows are needed; on clustered vectors a few
hundredths are.

Rows are grouped by the first half's centroid, cut into shards of about
``SHARD_BYTES`` by row, so a cell with a third of all vectors, or one vector
that stands a million times, is many groups.  A task holds one shard and
streams the queries past it in batches, which are sent to a group once, with
the list of their second-half centroids.  Every row is indexed.  Fitted: the
quantisers and the share, on about ``sample`` rows, twice as many at most.

Vectors that are null, zero, of another size than the most frequent one or
hold null or non-finite components take no part.  Ties go to the smaller
id.  Repeated ids are candidates each by itself; a query's own id is none.
A query is a distinct pair of id and vector: rows that repeat one are asked
once, and an id with several vectors has a list of ``k`` for each, told
apart by ``query_hash``, the hash of the vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.common import shuffle_partitions, stored

CELL_ROWS = 100
MOST_CENTROIDS = 512  # a half; the table of cell sizes goes through the driver
SHARD_BYTES = 16 << 20
BLOCK_SCORES = 2 << 20  # scores a task holds at once
TRIED_QUERIES = 500
#: Products summed in another order differ by less than this part of the lengths' product.
ROUNDING = 1e-9


def kmeans(rows: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of distinct rows; fewer than k if there are fewer rows."""
    rows = np.unique(rows, axis=0)
    k = min(k, len(rows))
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(steps):
        near = closest(rows, centroids)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def closest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * rows @ centroids.T, axis=1)


def traverse(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in falling order of left[i] + right[j], until those taken hold
    ``wanted`` rows; empty cells are passed by."""
    i_order, j_order = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen, out, held = [(-(left[i_order[0]] + right[j_order[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, a, b = heapq.heappop(heap)
        i, j = int(i_order[a]), int(j_order[b])
        if sizes[i, j]:
            out.append((i, j))
            held += int(sizes[i, j])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(left) and y < len(right) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(left[i_order[x]] + right[j_order[y]]), x, y))
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def needed_share(taken: np.ndarray, model: tuple[np.ndarray, np.ndarray], near: int, recall: float) -> float:
    """Least part of the rows of ``taken`` that queries among them must take,
    in the order of their cells, to hold ``recall`` of their ``near`` nearest."""
    one, two = model
    half = one.shape[1]
    c1, c2 = closest(taken[:, :half], one), closest(taken[:, half:], two)
    depths = []
    for q in np.linspace(0, len(taken) - 1, min(TRIED_QUERIES, len(taken))).astype(int):
        score = taken @ taken[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(near, len(taken) - 1)]
        closeness = (one @ taken[q, :half])[c1] + (two @ taken[q, half:])[c2]
        # a cell is taken whole
        depths.append(1 - np.searchsorted(np.sort(closeness), closeness[best]) / len(taken))
    depths = np.sort(np.concatenate(depths)) if depths else np.array([])
    return float(depths[int(np.ceil(recall * len(depths))) - 1]) if len(depths) else 1.0


def best_of(queries: np.ndarray, own: np.ndarray, listed: np.ndarray, rows: np.ndarray, ids: np.ndarray, c2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, score) of the k best rows of each query
    among those in cells it listed, without its own id."""
    at = np.flatnonzero(listed.any(axis=0)[c2])
    if len(at) < len(rows):
        rows, ids, c2 = rows[at], ids[at], c2[at]
    rough = queries @ rows.T
    rough[~listed[:, c2] | (ids[None, :] == own[:, None])] = -np.inf
    bar = np.full(len(queries), -np.inf)
    if len(rows) > k:
        bar = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k]
    slack = ROUNDING * np.sqrt((queries**2).sum(axis=1)) * np.sqrt((rows**2).sum(axis=1).max(initial=0))
    q, r = np.nonzero((rough >= (bar - slack)[:, None]) & (rough > -np.inf))
    score = np.empty(len(q))
    step = max(1, BLOCK_SCORES // queries.shape[1])
    for lo in range(0, len(q), step):
        # row sums in one fixed order: equal vectors have equal scores
        score[lo : lo + step] = (rows[r[lo : lo + step]] * queries[q[lo : lo + step]]).sum(axis=1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], at[r[first]], score[first]


def nearest_neighbours(
    vectors: DataFrame, is_query, k: int = 20, sample: int = 20_000, recall: float = 0.95, share: float | None = None, column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_hash): the k nearest found of each
    distinct row of ``vectors`` (vec_id and ``column``) for which ``is_query``
    holds.  ``share`` sets the part of the rows to rerank instead of measuring it."""
    spark = vectors.sparkSession
    v = F.col(column).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(sound & F.col("vec_id").isNotNull())
    by_size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double, query_hash long"
    if by_size is None:
        return spark.createDataFrame([], schema)
    size, n = int(by_size["size"]), int(by_size["count"])
    rows = rows.where(F.size("v") == size)
    half = max(1, size // 2)
    # distinct rows by hash, so a row that stands often is at most one of the sample
    hashed = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n // sample))) == 0).distinct().limit(2 * sample)
    taken = np.array(hashed.toPandas().sort_values("vec_id", kind="stable")["v"].tolist() or rows.limit(1).toPandas()["v"].tolist())
    k_half = int(min(MOST_CENTROIDS, max(4, round((n / CELL_ROWS) ** 0.5))))
    model = (kmeans(taken[:, :half], k_half), kmeans(taken[:, half:], k_half) if size > 1 else np.zeros((1, 0)))
    if share is None:
        share = needed_share(taken, model, max(1, -(-k * len(taken) // n)), recall)
    shared = spark.sparkContext.broadcast(model)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"), size)
                c = [pa.array(closest(m[:, :half], one).astype(np.int32)), pa.array(closest(m[:, half:], two).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *c], ["vec_id", "v", "c1", "c2"])

    placed = rows.mapInArrow(cells, "vec_id long, v array<double>, c1 int, c2 int")
    indexed = stored(placed.withColumn("row", F.monotonically_increasing_id()), "ann-index")
    counts = indexed.groupBy("c1", "c2").count().toPandas()  # at most MOST_CENTROIDS squared rows
    sizes = np.zeros((len(model[0]), len(model[1])), np.int64)
    sizes[counts["c1"], counts["c2"]] = counts["count"]
    wanted = max(k, int(np.ceil(share * n)))
    plan = spark.sparkContext.broadcast(sizes)
    shard_rows = max(1, SHARD_BYTES // (8 * size))
    n_shards = F.element_at(F.array(*[F.lit(int(max(1, -(-x // shard_rows)))) for x in sizes.sum(axis=1)]), F.col("c1") + 1)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                m, own = _matrix(batch.column("v"), size), batch.column("own").to_pylist()
                left, right, at, first, lists = m[:, :half] @ one.T, m[:, half:] @ two.T, [], [], []
                for q in range(len(m)):
                    by_first: dict[int, list[int]] = {}
                    # more by the rows of the query's own id, which are no candidates
                    for i, j in traverse(left[q], right[q], plan.value, wanted + own[q]):
                        by_first.setdefault(i, []).append(j)
                    at += [q] * len(by_first)
                    first += by_first.keys()
                    lists += by_first.values()
                asked = batch.select(["vec_id", "query_hash", "v"]).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*asked.columns, pa.array(first, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "query_hash", "v", "c1", "cells"]
                )

    repeated = indexed.groupBy("vec_id").agg(F.count("*").alias("own")).where("own > 1")
    queries = indexed.where(is_query).select("vec_id", "v").distinct().join(repeated, "vec_id", "left")
    queries = queries.select("vec_id", "v", F.xxhash64("v").alias("query_hash"), F.coalesce("own", F.lit(1)).alias("own"))
    asked = queries.repartition(shuffle_partitions(spark), "vec_id", "query_hash").mapInArrow(probes, "vec_id long, query_hash long, v array<double>, c1 int, cells array<int>")
    asked = asked.select("c1", F.explode(F.sequence(F.lit(0), n_shards - 1)).alias("shard"), F.lit(True).alias("asks"), "vec_id", "query_hash", "v", F.lit(None).cast("int").alias("c2"), "cells")
    stock = indexed.select(
        "c1", F.pmod(F.xxhash64("row"), n_shards).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id",
        F.lit(None).cast("long").alias("query_hash"), "v", "c2", F.lit(None).cast("array<int>").alias("cells"),
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_cells = len(shared.value[1])
        group, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in ("c1", "shard", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part, here = batch.slice(lo, hi - lo), tuple(keys[lo, :2])
                m, ids = _matrix(part.column("v"), size), part.column("vec_id").to_numpy()
                if here != group:
                    group, held, shard = here, [], None
                if not keys[lo, 2]:  # a group's rows come before its queries
                    held.append((m, ids, part.column("c2").to_numpy(zero_copy_only=False).astype(np.int32)))
                    continue
                if not held:
                    continue
                shard = shard or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                cells_ = part.column("cells")
                listed = np.zeros((len(m), n_cells), bool)
                listed[np.repeat(np.arange(len(m)), cells_.value_lengths().to_numpy()), cells_.flatten().to_numpy()] = True
                step = max(1, BLOCK_SCORES // len(shard[0]))
                for start in range(0, len(m), step):
                    block = slice(start, start + step)
                    q, r, score = best_of(m[block], ids[block], listed[block], *shard, k)
                    of = part.slice(start, step).select(["vec_id", "query_hash"]).take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([*of.columns, pa.array(shard[1][r]), pa.array(score)], ["query_id", "query_hash", "vec_id", "score"])

    met = stock.unionByName(asked).repartition(shuffle_partitions(spark), "c1", "shard").sortWithinPartitions("c1", "shard", "asks")
    found = met.mapInArrow(rerank, "query_id long, query_hash long, vec_id long, score double")
    # Spark takes the first k of each part before the window
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_hash")
