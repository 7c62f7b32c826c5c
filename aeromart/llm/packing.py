"""Packing of token ids into optimal length buckets.

Texts are encoded (the word encoder of the record writer) and end with the
end id.  The global histogram of exact sequence lengths goes to the driver,
at most one row for each length up to ``token_budget``, where dynamic
programming over the lengths chooses the bucket boundaries that give the
least padding; the minimum is found through the lower hull of lines, so it
takes time in proportion to lengths x buckets.  Inside each bucket sequences
are numbered and cut into batches of ``token_budget`` tokens, each sequence
padded to the bucket's longest.  A sequence longer than the budget is a
batch of its own without padding; these make the last bucket.

A batch is a row: the ids of its sequences padded and laid end to end, and
their true lengths, which are the attention lengths.  ``documents_of`` reads
the documents back from the batches.

The numbering never puts a bucket in one task: it runs in shards of each
bucket by a hash of a key of the row, so repeated ids and rows are spread
too, and shard offsets are summed from the shards' counts.  Only numbers are
numbered; the ids meet their place once, in a join on the row's key.

Null texts count as empty.  Empty texts have the end id alone.  Null and
repeated ids keep a row each; repeated rows are interchangeable.  Columns
other than doc_id and text are not used.  An empty table has no batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.common import shuffle_partitions, stored, text_chunks
from aeromart.llm.hashing import made_once
from aeromart.llm.records import WordEncoder

SHARD_ROWS = 200_000


def optimal_boundaries(longest: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Index of the last length of each bucket that minimises the padding.

    Lengths come in ascending order with the number of their sequences and
    the sum of their lengths.  Uses as few buckets as give the least.

    A bucket over the lengths i..j costs longest[j] * (c[j+1] - c[i]) -
    (t[j+1] - t[i]) with the running sums c and t.  For a fixed i that is a
    line in longest[j] with slope -c[i]; slopes fall as i grows and longest
    rises with j, so the lines of the lower hull are met in order.
    """
    n = len(counts)
    if not n:
        return []
    x = [int(v) for v in longest]
    c = [0, *np.cumsum(counts).tolist()]
    t = [0, *np.cumsum(totals).tolist()]
    best = [x[j] * c[j + 1] - t[j + 1] for j in range(n)]  # one bucket over 0..j
    choice = [[0] * n]
    for _ in range(1, min(buckets, n)):
        if best[-1] == 0:
            break
        more, cut = best.copy(), [-1] * n
        hull: deque[tuple[int, int, int]] = deque()  # (slope, height at 0, i)
        for j in range(1, n):
            line = (-c[j], best[j - 1] + t[j], j)
            # the middle one of three lines is never lowest if the outer two cross below it
            while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            while len(hull) > 1 and hull[0][0] * x[j] + hull[0][1] >= hull[1][0] * x[j] + hull[1][1]:
                hull.popleft()
            cost = hull[0][0] * x[j] + hull[0][1] + x[j] * c[j + 1] - t[j + 1]
            if cost < more[j]:
                more[j], cut[j] = cost, hull[0][2]
        choice.append(cut)
        best = more
    ends, j = [], n - 1
    for cut in reversed(choice[1:]):
        if cut[j] > 0:
            ends.append(j)
            j = cut[j] - 1
    ends.append(j)
    return ends[::-1]


def _encoded(tokenizer_path: Callable[[], str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = made_once(f"words {tokenizer_path()}", lambda: WordEncoder(tokenizer_path()))
            for a, b, data, offsets in text_chunks(batch, "text"):
                found = [np.append(ids, np.uint32(end_id)) for ids in encoder.encode(data, offsets)]
                wide = max(end_id, encoder.tokenizer.get_vocab_size()) >= 1 << 16
                ids = pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in found], pa.binary())
                sizes = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), ids, sizes], ["row", "doc_id", "ids", "length"])

    return run


def _padded(pad_id: int):
    """Batches with their sequences' bytes turned into padded ids, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for i in range(given.num_rows):
                row = given.slice(i, 1)
                width, members = row.column("bucket_length")[0].as_py(), row.column("members").flatten()
                lengths = members.field("length")
                out = np.full((len(members), width), pad_id, np.int32)
                for sequence, raw, n in zip(out, members.field("ids"), lengths.to_pylist(), strict=True):
                    raw = raw.as_buffer()
                    sequence[:n] = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (members.field("doc_id"), lengths, pa.array(out.ravel()))]
                yield pa.RecordBatch.from_arrays([*row.columns[:3], *lists], [*row.schema.names[:3], "doc_ids", "lengths", "input_ids"])

    return run


def tokenized(docs: DataFrame, tokenizer_path: Callable[[], str], end_id: int = 0) -> DataFrame:
    """(row, doc_id, ids, length) of ``docs`` (doc_id, text), stored; ``row``
    is a key of the row, ``ids`` are little-endian integers of two bytes
    (vocabularies below 65,536) or four."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(keyed.mapInArrow(_encoded(tokenizer_path, end_id), "row long, doc_id long, ids binary, length long"), "packing-sequences", "zstd")


def assign(sized: DataFrame, buckets: int, token_budget: int) -> DataFrame:
    """Place of each row of ``sized`` (row, length >= 1; stored): row, bucket
    (from 0), bucket_length, batch_id and slot in the batch (from 0)."""
    spark = sized.sparkSession
    within = F.when(F.col("length") <= token_budget, F.col("length"))
    histogram = sized.groupBy(within.alias("length")).agg(F.count("*").alias("n")).collect()  # at most token_budget + 1 rows
    n_long = sum(r["n"] for r in histogram if r["length"] is None)
    kinds = sorted((r["length"], r["n"]) for r in histogram if r["length"] is not None)
    lengths, counts = (np.array([k[i] for k in kinds], np.int64) for i in (0, 1))
    ends = optimal_boundaries(lengths, counts, lengths * counts, buckets)
    bounds = [int(lengths[e]) for e in ends]
    sums = np.concatenate([[0], np.cumsum(counts)])
    rows = [*np.diff([0, *[sums[e + 1] for e in ends]]).tolist(), n_long]
    capacity = [*[token_budget // b for b in bounds], 1]
    first_batch = np.concatenate([[0], np.cumsum([-(-n // k) for n, k in zip(rows, capacity, strict=True)])])[:-1].tolist()

    def of_bucket(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    bucket = reduce(lambda found, b: found + (F.col("length") > b).cast("int"), bounds, F.lit(0))
    shards = max(shuffle_partitions(spark), -(-sum(rows) // SHARD_ROWS))
    dealt = sized.select("row", "length", bucket.alias("bucket"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row")) - 1
    numbered = dealt.withColumn("place", place).join(offsets, ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("before"))
    own_length = F.when(F.col("bucket") == len(bounds), F.col("length"))
    return numbered.select(
        "row",
        F.col("bucket").cast("int").alias("bucket"),
        F.coalesce(own_length, of_bucket([*bounds, 0])).alias("bucket_length"),
        (of_bucket(first_batch) + F.floor(F.col("place") / of_bucket(capacity))).alias("batch_id"),
        F.pmod(F.col("place"), of_bucket(capacity)).cast("int").alias("slot"),
    )


def pack(docs: DataFrame, tokenizer_path: Callable[[], str], buckets: int = 16, token_budget: int = 65_536, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row a batch: batch_id, bucket, bucket_length, doc_ids, lengths
    (attention lengths) and input_ids (each sequence padded with ``pad_id``
    to bucket_length, end to end)."""
    sequences = tokenized(docs, tokenizer_path, end_id)
    places = assign(sequences.select("row", "length"), buckets, token_budget)
    # a group is a batch: no more than token_budget ids, or one sequence
    member = F.struct("slot", "doc_id", "length", "ids")
    batches = sequences.join(places, "row").groupBy("batch_id").agg(
        F.min("bucket").alias("bucket"), F.min("bucket_length").alias("bucket_length"), F.array_sort(F.collect_list(member)).alias("members")
    )
    schema = "batch_id long, bucket int, bucket_length long, doc_ids array<long>, lengths array<long>, input_ids array<int>"
    return batches.mapInArrow(_padded(pad_id), schema)


def documents_of(batches: DataFrame) -> DataFrame:
    """One row a document, read back from batches: doc_id, length, bucket,
    bucket_length, batch_id, slot, padding, and ids_crc32, the checksum of its
    ids (without padding) in decimal, joined by commas."""
    members = batches.select("batch_id", "bucket", "bucket_length", "input_ids", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("slot", "m"))
    ids = F.slice("input_ids", (F.col("slot") * F.col("bucket_length") + 1).cast("int"), F.col("m.lengths").cast("int"))
    return members.select(
        F.col("m.doc_ids").alias("doc_id"),
        F.col("m.lengths").alias("length"),
        "bucket",
        "bucket_length",
        "batch_id",
        "slot",
        (F.col("bucket_length") - F.col("m.lengths")).alias("padding"),
        F.crc32(F.array_join(ids.cast("array<string>"), ",").cast("binary")).alias("ids_crc32"),
    )
