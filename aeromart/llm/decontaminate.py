"""Benchmark decontamination with SimHash windows.

For every benchmark item the documents are read in windows of the item's
size in words.  A window and an item are alike when the weighted Jaccard
similarity of their word shingles (weight: how often a shingle occurs) is
at least ``percent`` / 100.  Three steps, each wider than the next:

1. A window can only be that alike if enough of its shingles occur in items
   of the size, so windows with fewer are passed over in the scan.  This
   bound is exact.
2. The others get a 64-bit SimHash of their weighted shingles.  Multi-index
   Hamming search: fingerprints are cut into blocks; if two differ in at
   most ``radius`` bits, some block differs in at most radius / blocks of
   its bits, so items are entered under all block values that near and
   every fingerprint within the radius meets its item in a join.
3. The pairs within the radius are verified by their exact similarity.

At a similarity of 0.75 fingerprints differ in 11 of 64 bits on average
(standard deviation 3); the default radius of 24 leaves a wide margin.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, case
folded in ASCII.  An item of fewer than five words has its whole word
sequence as its one shingle; an item without words matches nothing.  A
document shorter than an item is one window.  Null texts have no words,
null ids stay null in the result.  Repeated rows give the same matches
once for each id.

The items' shingle table is broadcast in parts of at most ``INDEX_SHINGLES``
(expected) shingles, one scan of the documents for each part, so it is
bounded however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.common import stored, text_chunks
from aeromart.llm.hashing import U, alnum_word_bytes, mix, running, shingle_hashes, span_hashes, word_spans

INDEX_SHINGLES = 2_000_000
BITS, BLOCKS = 64, 8
WINDOW_ROW = "doc_id long, size int, start_word long, n_words int, start_byte long, end_byte long, fingerprint long, shingles array<long>"


def numbered(shingles: np.ndarray) -> np.ndarray:
    """Make the k-th occurrence of a shingle its own value, so that set
    operations on the result count multiplicities."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(shingles)
    out[order] = mix(s + nth.astype(U) * U(0x9E3779B97F4A7C15))
    return out


def sign_sums(shingles: np.ndarray) -> np.ndarray:
    """Running sums over the shingles of +1 or -1 for each fingerprint bit."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash of each row of summed signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch, "text"):
            starts, ends, firsts = word_spans(data, offsets, alnum_word_bytes())
            words = span_hashes(running(data, fold_case=True), starts, ends)
            rows = []
            for row, (p, q) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                if q > p:
                    s = shingle_hashes(words[p:q], min(5, q - p))
                    fp = fingerprints(sign_sums(s)[-1:])
                    rows.append((batch.column(0)[a + row].as_py(), q - p, int(fp.view(np.int64)[0]), s.view(np.int64), numbered(s).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                ],
                ["item_id", "size", "fingerprint", "plain", "shingles"],
            )


def _windows(index, percent: int):
    """Windows of the items' sizes that hold enough of their shingles."""

    def of_size(size: int, words: np.ndarray, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple]:
        """Windows (start, words, fingerprint, shingles) of one document."""
        k = min(5, size)
        full, have = size - k + 1, min(size, len(words)) - k + 1
        need = -(-(full + have) * percent // (100 + percent))
        marks = np.zeros(len(shingles) + 1, np.int64)
        marks[hits + 1] = 1
        counts = np.cumsum(marks)
        starts = np.flatnonzero(counts[have:] - counts[: len(counts) - have] >= max(need, 1))
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            if len(run):
                part = shingles[run[0] : run[-1] + have]
                sums, at = sign_sums(part), run - run[0]
                for s, fp in zip(at.tolist(), fingerprints(sums[at + have] - sums[at]).view(np.int64).tolist(), strict=True):
                    yield int(run[0]) + s, have + k - 1, fp, numbered(part[s : s + have]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = index.value  # size -> sorted shingles
        lengths = sorted({min(5, m) for m in sizes})
        known = {k: np.unique(np.concatenate([s for m, s in sizes.items() if min(5, m) == k])) for k in lengths}
        masks = {}
        for k, values in known.items():
            masks[k] = np.zeros(1 << 22, bool)
            masks[k][(values >> U(42)).astype(np.int64)] = True
        for batch in batches:
            rows = []
            for a, _, data, offsets in text_chunks(batch, "text"):
                starts, ends, firsts = word_spans(data, offsets, alnum_word_bytes())
                words = span_hashes(running(data, fold_case=True), starts, ends)
                for k in lengths:
                    shingles = shingle_hashes(words, k)
                    maybe = np.flatnonzero(masks[k][(shingles >> U(42)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(known[k], shingles[maybe]), len(known[k]) - 1)
                    maybe = maybe[known[k][at] == shingles[maybe]]
                    # not across texts
                    doc = np.searchsorted(firsts, maybe, side="right") - 1
                    inside = maybe + k <= firsts[doc + 1]
                    maybe, doc = maybe[inside], doc[inside]
                    for d in np.unique(doc).tolist():
                        p, q = int(firsts[d]), int(firsts[d + 1])
                        hits = maybe[doc == d] - p
                        found = shingles[p + hits]
                        for size, values in sizes.items():
                            if min(5, size) != k:
                                continue
                            at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                            own = hits[values[at] == found]
                            if len(own):
                                for start, n, fp, shingle in of_size(size, words[p:q], shingles[p : q - k + 1], own):
                                    base = int(offsets[d])
                                    rows.append(
                                        (batch.column(0)[a + d].as_py(), size, start, n, int(starts[p + start]) - base, int(ends[p + start + n - 1]) - base, fp, shingle)
                                    )
                if len(rows) > 5000:
                    yield _window_batch(rows)
                    rows = []
            yield _window_batch(rows)

    return run


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc_id", "size", "start_word", "n_words", "start_byte", "end_byte", "fingerprint", "shingles"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def nearby_values(bits: int, distance: int) -> list[int]:
    """Masks that flip at most ``distance`` of ``bits`` bits."""
    return [sum(1 << b for b in flips) for d in range(distance + 1) for flips in combinations(range(bits), d)]


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, radius: int = 24) -> DataFrame:
    """One row for each document and item of which it holds a near copy: the
    most similar window (the earliest of those), its place and similarity."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    items = stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).mapInArrow(
            _items, "item_id long, size int, fingerprint long, plain array<long>, shingles array<long>"
        ).withColumn("item", F.monotonically_increasing_id()),  # an item without an id is one too
        "decontaminate-items",
    )
    total = items.agg(F.sum(F.size("plain"))).first()[0] or 0
    parts = max(1, -(-total // INDEX_SHINGLES))
    windows = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("size", F.explode("plain").alias("s")).distinct().toPandas()
        sizes = {int(m): np.sort(g.to_numpy(np.int64).view(np.uint64)) for m, g in rows.groupby("size")["s"]}
        found = docs.mapInArrow(_windows(spark.sparkContext.broadcast(sizes), percent), WINDOW_ROW) if sizes else spark.createDataFrame([], WINDOW_ROW)
        windows = found if windows is None else windows.unionByName(found)
    windows = stored(windows.withColumn("window_id", F.monotonically_increasing_id()), "decontaminate-windows")

    width = BITS // BLOCKS
    flips = nearby_values(width, radius // BLOCKS)

    def block(n):
        return F.shiftrightunsigned("fingerprint", n * width).bitwiseAND(F.lit((1 << width) - 1))

    def blocks(values):
        return F.explode(F.array(*[F.struct(F.lit(n).alias("block"), block(n).alias("value")) for n in range(values)]))

    entered = (
        items.select("item", "size", F.col("fingerprint").alias("item_fingerprint"), blocks(BLOCKS).alias("at"))
        .select("item", "size", "item_fingerprint", "at.block", F.col("at.value").alias("near"), F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"))
        .withColumn("value", F.col("near").bitwiseXOR(F.col("flip")))
        .select("item", "size", "item_fingerprint", "block", "value")
    )
    looked_up = windows.select("window_id", "size", "fingerprint", blocks(BLOCKS).alias("at")).select("window_id", "size", "fingerprint", "at.block", "at.value")
    pairs = (
        looked_up.join(entered, ["size", "block", "value"])
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
        .select("window_id", "item")
        .distinct()
    )
    both = F.size(F.array_intersect("shingles", "item_shingles"))
    alike = (
        pairs.join(windows, "window_id")
        .join(items.select("item", "item_id", F.col("shingles").alias("item_shingles")), "item")
        .withColumn("both", both)
        .withColumn("either", F.size("shingles") + F.size("item_shingles") - F.col("both"))
        .where(F.col("both") * 100 >= F.col("either") * percent)
        .withColumn("similarity", F.col("both") / F.col("either"))
    )
    best = Window.partitionBy("doc_id", "item_id", F.when(F.col("item_id").isNull(), F.col("item"))).orderBy(F.desc("similarity"), "start_word", "size")
    return (
        alike.withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("doc_id", "item_id", "similarity", "start_word", F.col("n_words").cast("long").alias("n_words"), "start_byte", "end_byte")
    )
