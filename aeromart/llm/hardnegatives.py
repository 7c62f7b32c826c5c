"""Hard negatives by coordinate pruning over length buckets (after LEMP).

Rows are sorted by vector length and cut into buckets of at most
``BUCKET_ROWS``.  A bucket holds, for each coordinate, the list of its rows
sorted by that coordinate of the normalised vector.  An anchor that needs
scores of at least t first asks whether its length times the bucket's
largest can reach t.  If so, the cosine a row needs, c = t / (that product),
bounds the angle to arccos(c), and so, for each of the anchor's focus
coordinates (its largest), the range of values that a row can have there.
The rows of these ranges are found in the sorted lists, the candidate sets
are intersected, and what is left is scored exactly with integers.

Thresholds: for positives the k-th best score of a row with the anchor's
label in the bucket of the longest vectors; for the negatives of a positive
the lower end of its score range, or the k-th best score of the range in
that bucket.  Both are reached by real rows, so nothing better is pruned.
Where a bucket has too few rows for a threshold, all its rows are scored.

Anchors are the stated query set; they meet the buckets in blocks of
``ANCHOR_ROWS``, so a task holds one bucket and one block.  Each pair of
them returns at most k rows an anchor (or an anchor's positive), which the
final ranking cuts again before its shuffle.

Components are floor(``scale`` * x).  Higher scores come first, then
smaller ids, a null id last.  A row is no positive or negative of itself,
whatever its id: rows that repeat an id are rows of their own, and an anchor
row that stands twice has its results twice.  Left out: rows with a null
label, a null vector or a null or non-finite component, and vectors of
another size than the most frequent one (the smaller of two).  Components so
large that a score doesn't fit a long are an error.  An anchor without
another row of its label has no row, nor has a pair without a negative in
range.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.blocks import as_integers, common_size, matrix, packed, runs, sound_vector
from aeromart.llm.common import shuffle_partitions, stored

BUCKET_ROWS, ANCHOR_ROWS = 8192, 512
#: Coordinates of an anchor whose ranges are looked up.
FOCUS = 4
#: Share of a bucket from which on candidates are scored by one product over it.
DENSE = 0.1

BUCKET = "longest double, row binary, vec_id binary, no_id binary, label binary, vectors binary, lists binary"
ANCHORS = "row binary, vec_id binary, label binary, vectors binary, least binary"


def _buckets(size: int):
    """Buckets of rows that come in falling length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, BUCKET_ROWS):
            values = matrix(rows.column("v").combine_chunks(), size)
            length = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
            unit = values / np.maximum(length, 1)[:, None]
            lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
            ids = rows.column("vec_id")
            columns = {
                "longest": pa.array([length.max()]),
                "row": pa.array([packed(rows.column("row").to_numpy())]),
                "vec_id": pa.array([packed(ids.fill_null(0).to_numpy())]),
                "no_id": pa.array([packed(ids.is_null().to_numpy())]),
                "label": pa.array([packed(rows.column("label").to_numpy())]),
                "vectors": pa.array([packed(values)]),
                "lists": pa.array([packed(lists)]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _anchor_blocks(size: int):
    """Blocks of anchors; ``ranges`` (positive's row, id, lower, upper bound) of each, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ANCHOR_ROWS):
            arrays = [packed(rows.column(c).to_numpy()) for c in ("row", "vec_id", "label")]
            arrays += [packed(matrix(rows.column("v").combine_chunks(), size)), b""]
            columns = [pa.array([x], pa.binary()) for x in arrays]
            names = ["row", "vec_id", "label", "vectors", "least"]
            if "pairs" in rows.column_names:
                pairs = rows.column("pairs").combine_chunks()
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs))
                names.append("pairs")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


class _Bucket:
    def __init__(self, batch: pa.RecordBatch, i: int, size: int) -> None:
        get = lambda name, kind: np.frombuffer(batch.column(f"b_{name}")[i].as_buffer(), kind)
        self.row, self.vec_id, self.label = (get(x, np.int64) for x in ("row", "vec_id", "label"))
        self.no_id = get("no_id", np.bool_)
        self.vectors = get("vectors", np.int64).reshape(-1, size)
        self.lists = get("lists", np.uint16).reshape(size, -1)
        self.longest = batch.column("b_longest")[i].as_py()
        self.length = np.maximum(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)), 1)
        self.most = int(np.abs(self.vectors).max(initial=0))
        self.ranked: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        """Coordinate f of the normalised rows, in the order of its list."""
        if f not in self.ranked:
            order = self.lists[f]
            self.ranked[f] = self.vectors[order, f] / self.length[order]
        return self.ranked[f]

    def candidates(self, anchor: np.ndarray, least: float) -> np.ndarray:
        """Mask of the rows that can score ``least`` or more."""
        n = len(self.row)
        own = math.sqrt((anchor.astype(np.float64) ** 2).sum())
        if least <= 0:
            return np.ones(n, bool)
        reach = own * self.longest * (1 + 1e-12)
        if least > reach:
            return np.zeros(n, bool)
        angle = math.acos(min(1.0, least / reach))
        hits = np.zeros(n, np.int8)
        focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
        for f in focus.tolist():
            at = math.acos(max(-1.0, min(1.0, anchor[f] / own)))
            low, high = math.cos(min(math.pi, at + angle)) - 1e-9, math.cos(max(0.0, at - angle)) + 1e-9
            values = self.values(f)
            hits[self.lists[f][np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]] += 1
        return hits == len(focus)

    def scored(self, anchors: np.ndarray, least: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidate rows, their scores) for each anchor; ``wanted``
        (anchor) masks the rows that are asked for."""
        exact = self.vectors.shape[1] * self.most * int(np.abs(anchors).max(initial=0)) < 2**53
        kind = np.float64 if exact else np.int64  # doubles hold these sums exactly
        rows = self.vectors.astype(kind)
        for a in range(0, len(anchors), 64):
            part = anchors[a : a + 64]
            masks = np.array([self.candidates(x, t) & wanted(a + i) for i, (x, t) in enumerate(zip(part, least[a : a + 64], strict=True))])
            dense = masks.mean(axis=1) > DENSE
            products = (part[dense].astype(kind) @ rows.T) if dense.any() else None
            at = np.cumsum(dense) - 1
            for i, mask in enumerate(masks):
                found = np.flatnonzero(mask)
                scores = products[at[i]][found] if dense[i] else rows[found] @ part[i].astype(kind)
                yield a + i, found, scores.astype(np.int64)

    def best(self, found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``found`` of the k best: higher score, smaller id, null id last."""
        if len(found) > k:
            enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            places = np.flatnonzero(enough)
        else:
            places = np.arange(len(found))
        rows = found[places]
        return places[np.lexsort((self.row[rows], self.vec_id[rows], self.no_id[rows], -scores[places]))[:k]]


class _Anchors:
    def __init__(self, batch: pa.RecordBatch, i: int, size: int) -> None:
        get = lambda name, kind: np.frombuffer(batch.column(f"a_{name}")[i].as_buffer(), kind)
        self.row, self.vec_id, self.label = (get(x, np.int64) for x in ("row", "vec_id", "label"))
        self.vectors = get("vectors", np.int64).reshape(-1, size)
        least = get("least", np.float64)
        self.least = least if len(least) else np.full(len(self.row), -np.inf)


def _pairs(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Bucket, _Anchors]]:
    """Bucket and anchor block of each row; a bucket stays while rows repeat it."""
    key, bucket = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column("b_row")[i].as_buffer().to_pybytes()[:8]
            if own != key:
                key, bucket = own, _Bucket(batch, i, size)
            yield batch, i, bucket, _Anchors(batch, i, size)


def _first_thresholds(size: int, k: int):
    """The anchor blocks, each anchor with its k-th best positive score in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, bucket, block in _pairs(size, batches):
            least = np.full(len(block.row), -np.inf)
            for a, found, scores in bucket.scored(block.vectors, block.least, lambda a: (bucket.label == block.label[a]) & (bucket.row != block.row[a])):
                if len(found) >= k:
                    least[a] = scores[bucket.best(found, scores, k)[-1]]
            columns = [batch.column(f"a_{c}").slice(i, 1) for c in ("row", "vec_id", "label", "vectors")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed(least)], pa.binary())], ["row", "vec_id", "label", "vectors", "least"])

    return run


def _positives(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, bucket, block in _pairs(size, batches):
            out = []
            for a, found, scores in bucket.scored(block.vectors, block.least, lambda a: (bucket.label == block.label[a]) & (bucket.row != block.row[a])):
                for p in bucket.best(found, scores, k).tolist():
                    out.append((block.row[a], bucket.row[found[p]], None if bucket.no_id[found[p]] else bucket.vec_id[found[p]], scores[p]))
            yield _rows(out, ["anchor", "positive", "positive_id", "positive_score"])

    return run


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)


def _negatives_in(bucket: _Bucket, block: _Anchors, pairs: list[list[dict]], k: int, floor: str) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
    """(anchor, pair, rows, scores) of the k best rows of another label that
    are in the pair's range, from its bound ``floor`` on."""
    least = np.array([min((p[floor] for p in own), default=np.inf) for own in pairs], np.float64)
    for a, found, scores in bucket.scored(block.vectors, least, lambda a: bucket.label != block.label[a]):
        for pair in pairs[a]:
            inside = np.flatnonzero((scores >= pair[floor]) & (scores <= pair["high"]))
            own = inside[bucket.best(found[inside], scores[inside], k)]
            yield a, pair, found[own], scores[own]


def _first_bounds(size: int, k: int):
    """The anchor blocks, each pair's bound raised to its k-th best negative in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, bucket, block in _pairs(size, batches):
            pairs = batch.column("a_pairs")[i].as_py()
            for _, pair, rows, scores in _negatives_in(bucket, block, pairs, k, "low"):
                if len(rows) == k:
                    pair["least"] = int(scores[-1])
            columns = [batch.column(f"a_{c}").slice(i, 1) for c in ("row", "vec_id", "label", "vectors", "least")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([pairs], batch.schema.field("a_pairs").type)], ["row", "vec_id", "label", "vectors", "least", "pairs"])

    return run


def _negatives(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, bucket, block in _pairs(size, batches):
            out = []
            for a, pair, rows, scores in _negatives_in(bucket, block, batch.column("a_pairs")[i].as_py(), k, "least"):
                for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
                    negative = None if bucket.no_id[r] else bucket.vec_id[r]
                    out.append((block.row[a], block.vec_id[a], pair["positive"], pair["positive_id"], pair["positive_score"], negative, bucket.row[r], s))
            yield _rows(out, ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative", "negative_score"])

    return run


def _met(buckets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of the stated query set with every bucket."""
    left = buckets.select(*[F.col(c).alias(f"b_{c}") for c in buckets.columns])
    return left.crossJoin(anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]))


def ranked(found: DataFrame, group: list[str], score: str, vec_id: str, row: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.asc_nulls_last(vec_id), row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, column: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows of ``vectors`` (vec_id, an integer label and
    ``column``) for which ``is_anchor`` holds: for each of an anchor's best
    ``positives`` rows of its label, the best ``negatives`` rows of other
    labels that score ``low`` to ``high`` percent of the positive."""
    spark = vectors.sparkSession
    v = F.col(column).cast("array<double>")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    rows = rows.where(sound_vector(F.col("v")) & F.col("label").isNotNull()).withColumn("v", as_integers(F.col("v"), scale))
    # the number of a row hangs on how the table is read: written once
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = common_size(rows, "v")
    if found is None:
        return spark.createDataFrame([], schema)
    size, _, most = found
    if size * max(1, most) ** 2 * max(100, low, high) >= 2**63:
        raise ValueError("components are too large for scores in a long")
    rows = rows.where(F.size("v") == size)
    parts = shuffle_partitions(spark)

    length = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    by_length = rows.withColumn("square", length).repartitionByRange(parts, F.desc("square"), "row").sortWithinPartitions(F.desc("square"), "row")
    buckets = stored(by_length.select("row", "vec_id", "label", "v").mapInArrow(_buckets(size), BUCKET), "negatives-buckets")
    longest = buckets.orderBy(F.desc("longest"), "row").limit(1)

    asking = rows.where("asks and vec_id is not null")
    blocks = asking.select("row", "vec_id", "label", "v").mapInArrow(_anchor_blocks(size), ANCHORS)
    blocks = stored(_met(longest, blocks).mapInArrow(_first_thresholds(size, positives), ANCHORS), "negatives-anchors")
    best = _met(buckets, blocks).mapInArrow(_positives(size, positives), "anchor long, positive long, positive_id long, positive_score long")
    best = ranked(best, ["anchor"], "positive_score", "positive_id", "positive", positives)

    # low * positive <= 100 * negative <= high * positive, in integers
    score = F.col("positive_score")
    lowest, highest = -F.floor(-score * low / F.lit(100).cast("decimal(3,0)")), F.floor(score * high / F.lit(100).cast("decimal(3,0)"))
    pair = F.struct("positive", "positive_id", "positive_score", lowest.cast("long").alias("low"), highest.cast("long").alias("high"), lowest.cast("long").alias("least"))
    pairs = best.where(lowest <= highest).groupBy("anchor").agg(F.collect_list(pair).alias("pairs"))  # at most `positives` an anchor
    kind = dict(pairs.dtypes)["pairs"]
    ready = asking.join(pairs, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "v", "pairs")
    blocks = ready.mapInArrow(_anchor_blocks(size), f"{ANCHORS}, pairs array<{kind}>")
    blocks = stored(_met(longest, blocks).mapInArrow(_first_bounds(size, negatives), f"{ANCHORS}, pairs array<{kind}>"), "negatives-pairs")
    out = _met(buckets, blocks).mapInArrow(
        _negatives(size, negatives),
        "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative long, negative_score long",
    )
    out = ranked(out, ["anchor", "positive"], "negative_score", "negative_id", "negative", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
