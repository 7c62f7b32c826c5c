"""N-gram Jaccard join with parity sketches.

Two documents link when the Jaccard similarity of their sets of word
shingles is at least ``percent`` / 100.  For sets of a and b shingles that
means |A xor B| <= T(a + b), so the sets are compared by parity sketches:

* A document's shingles are dealt by hash into N blocks and each block keeps
  the XOR of its shingles' hashes.  Each shingle of the symmetric
  difference changes one block, so at most T blocks of a linked pair
  differ: the number of unequal blocks bounds the difference from below.
* N is fixed for a size band (a factor of four), so both documents of a
  pair use the same blocks; a document near the upper border also sketches
  for the band above.
* By the pigeonhole principle a linked pair shares at least N - T - E
  filled blocks (E: blocks empty in one of them).  Of its filled blocks a
  document may therefore leave out the last N - T - E - 1 in an order that
  is the same for all documents, and some shared block is still kept by
  both.  The order puts blocks of common shingles last, so a passage that
  many documents share makes no keys unless it is most of the document.
  (The frequencies come from a bounded sample and only order the keys;
  any order finds the same links.)
* Documents with so few filled blocks that nothing is guaranteed sketch
  again with more blocks, until the guarantee holds; their partners do
  the same.

Kept blocks are packed per task and bucket, and the pairs that meet in a
block are first compared by folded bit sketches (XOR of one bit a
shingle: their Hamming distance bounds the difference from below) and
then verified on the texts.  A block with few classes gives all its pairs; one
with many is taken in two rounds: each member against its centre, then,
across the components this leaves, the members still apart, whose sketches
are compared in blocks inside tasks.  Documents with the same
shingle set are one class throughout, so copies are never paired.

Nulls and texts without words have an empty set and no links.  Null ids
are kept as rows of their own kind (component null).  Repeated ids count
as copies of a document with that id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.common import shuffle_partitions, stored, text_chunks
from aeromart.llm.components import connected_components
from aeromart.llm.hashing import U, mix, shingle_sets

BAND = 4  # a band's upper size over its lower size
SPREAD = 12  # blocks for each difference a pair of the band may have
SPARE = 16  # a band's spare keys: one for this many shingles of its upper size, and a few
CROWD = 8  # classes of a block up to which all its pairs are compared at once
WANTED_IDS = 500_000  # document ids up to which they are broadcast
BLOCK_ROWS = 2000  # members of a crowded block that are compared in one step
SAMPLE_DOCS = 20_000  # documents (expected) whose shingles are counted for the key order
COMMON = 200_000  # most frequent shingles of the sample that are kept


def max_difference(total: int, percent: int) -> int:
    """Largest |A xor B| of a linked pair with |A| + |B| = total."""
    return total * (100 - percent) // (100 + percent)


def class_id(shingles: np.ndarray) -> int:
    """64-bit digest of a set (sum and XOR of its mixed hashes, and its size)."""
    m = mix(shingles + U(0x51ED270B))
    both = np.array([m.sum(dtype=U), np.bitwise_xor.reduce(mix(m)), len(m)], dtype=U)
    return int(shingle_mix(both).view(np.int64)[0])


def shingle_mix(parts: np.ndarray) -> np.ndarray:
    out = parts[:1].copy()
    for k in range(1, len(parts)):
        out = mix(out * U(0x9FB21C651E98DF25) + parts[k : k + 1])
    return out


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_chunks(batch, "text"):
                sets = list(shingle_sets(data, offsets, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "class_id"],
                )

    return run


def _sample_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "text"):
                values, counts = np.unique(np.concatenate([np.zeros(0, U), *shingle_sets(data, offsets, size)]), return_counts=True)
                keep = slice(None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["shingle", "n"]
                )

    return run


def _keys_of_band(shingles: np.ndarray, weight: np.ndarray, top: int, limit: int, percent: int) -> tuple[np.ndarray, int]:
    """Kept block keys of one document for the band of sizes below ``top``, and
    how many of those of the first level it may still leave out.

    ``limit`` is the largest difference that this document's own links in
    the band can have.  A linked pair shares at least (filled - limit)
    filled blocks, of which both keep the first (1 + spare) if there are so
    many.  A document with no more filled blocks than ``limit`` keeps them
    all and goes on to a level with more blocks: only a pair of which both
    are such documents can be missed before.
    """
    blocks, level, out, spare = SPREAD * (max_difference(2 * (top - 1), percent) + 1), 0, [], 0
    while True:
        seed = U((top * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        h = mix(shingles ^ seed)
        block = (h >> U(32)) % U(blocks)
        order = np.argsort(block, kind="stable")
        sorted_blocks = block[order]
        firsts = np.flatnonzero(np.concatenate([[True], sorted_blocks[1:] != sorted_blocks[:-1]]))
        keys = mix(np.bitwise_xor.reduceat(h[order], firsts) + mix(sorted_blocks[firsts] + seed))
        rarest = np.minimum.reduceat(weight[order], firsts)
        more = top // SPARE + 8 if level == 0 else 0
        # the upper bits tell the family: band, and whether the first level
        family = U((top.bit_length() // 2 % 16) * 2 + (level > 0))
        keys = (keys >> U(5)) | (family << U(59))
        out.append(keys[np.lexsort((keys, rarest))[: limit + 1 + more]])
        if level == 0:
            spare = max(0, min(more, len(firsts) - limit - 1))
        if len(firsts) > limit:
            return np.concatenate(out), spare
        blocks, level = blocks * 16 + 1, level + 1


def document_keys(shingles: np.ndarray, weight: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """All kept block keys of a document, and its size and spare counts in one
    integer: the size, and above 32 and 48 bits the spare keys of its own
    band and of the next."""
    a = len(shingles)
    top = BAND
    while top <= a:
        top *= BAND
    largest = a * 100 // percent  # size of the largest set it can link to
    keys, own = _keys_of_band(shingles, weight, top, max_difference(a + min(largest, top - 1), percent), percent)
    following = 0
    if largest >= top:
        more, following = _keys_of_band(shingles, weight, top * BAND, max_difference(a + largest, percent), percent)
        keys = np.concatenate([keys, more])
    return keys, a | min(own, 0xFFFF) << 32 | min(following, 0x7FFF) << 48


def _packed_keys(size: int, percent: int, buckets: int, common):
    """Per task batch and bucket one blob of (key, class) of the kept blocks."""

    def pack(kind: int, bucket: int, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple:
        used, local = np.unique(ids, return_inverse=True)
        high = (keys >> U(16)).astype(np.uint64)
        six = high.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        first = np.zeros(len(used), np.int64)
        first[local] = sizes
        wide = local.astype(np.uint16 if len(used) < 65536 else np.uint32)
        head = np.array([kind, bucket, len(keys), len(used), wide.itemsize], np.int64).tobytes()
        return bucket, head + used.astype(np.int64).tobytes() + first.astype(np.int64).tobytes() + six + wide.tobytes()

    def flush(keys: list, ids: list, sizes: list) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        lens = [len(k) for k in keys]
        k, c, n = np.concatenate(keys), np.repeat(np.array(ids, np.int64), lens), np.repeat(np.array(sizes, np.int64), lens)
        bucket = (k & U(0xFFFF)) * U(buckets) >> U(16) if buckets <= 65536 else k % U(buckets)
        # one entry a (key, class)
        order = np.lexsort((c, k, bucket))
        k, c, n, bucket = k[order], c[order], n[order], bucket[order].astype(np.int64)
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        k, c, n, bucket = k[new], c[new], n[new], bucket[new]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        group = np.cumsum(first) - 1
        crowded = np.bincount(group)[group] > CROWD
        rows = []
        direct = np.flatnonzero(crowded)
        if len(direct):  # already known to be shared: dealt out evenly, with one marked entry to be grouped
            rows.append(pack(1, int(k[direct[0]] % U(buckets)), k[direct], c[direct], n[direct]))
        for kind, chosen in ((0, ~crowded), (2, crowded & first)):
            kk, cc, nn, bb = k[chosen], c[chosen], n[chosen], bucket[chosen]
            if len(kk):
                cuts = np.flatnonzero(np.concatenate([[True], bb[1:] != bb[:-1]])).tolist() + [len(kk)]
                rows += [pack(kind, int(bb[a]), kk[a:b], cc[a:b], nn[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.large_binary()).cast(pa.binary())], ["bucket", "blob"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, count = common.value
        keys, ids, sizes, held, seen = [], [], [], 0, set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "text"):
                for s in shingle_sets(data, offsets, size):
                    if not len(s) or (c := class_id(s)) in seen:
                        continue
                    seen.add(c)
                    if len(shingle):
                        at = np.minimum(np.searchsorted(shingle, s), len(shingle) - 1)
                        weight = np.where(shingle[at] == s, count[at], 0)
                    else:
                        weight = np.zeros(len(s), np.int64)
                    own, size_and_spare = document_keys(s, weight, percent)
                    keys.append(own)
                    ids.append(c)
                    sizes.append(size_and_spare)
                    held += len(keys[-1])
                    if held >= 800_000:
                        yield from flush(keys, ids, sizes)
                        keys, ids, sizes, held, seen = [], [], [], 0, set()
        yield from flush(keys, ids, sizes)

    return run


def _shared_keys(percent: int):
    """What classes share blocks: all pairs (c, d) of a block with few classes,
    each pair once a bucket, and rows (key, c) of a block with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                kind, bucket, n, m, width = np.frombuffer(blob, np.int64, 5).tolist()
                at = 40
                used = np.frombuffer(blob, np.int64, m, at)
                sizes = np.frombuffer(blob, np.int64, m, at + 8 * m)
                at += 16 * m
                key = np.zeros((n, 8), np.uint8)
                key[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
                key = key.view(np.uint64).reshape(n)
                local = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, n, at + 6 * n)
                if kind == 1:
                    yield from _key_rows(key, used[local], sizes[local])
                else:
                    held.setdefault(bucket, []).append((key, used, sizes, local, np.full(n, kind == 2)))
        for bucket in list(held):
            parts = held.pop(bucket)
            # classes by position, so that sorting moves eight bytes a key
            base = np.cumsum([0] + [len(p[1]) for p in parts])
            key = np.concatenate([p[0] for p in parts])
            where = np.concatenate([p[3].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
            used, sizes = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            marked = np.concatenate([p[4] for p in parts])  # stands for a crowd of its batch
            del parts
            order = np.argsort(key)
            key, where, marked = key[order], where[order], marked[order]
            same = key[1:] == key[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            key, where, marked = key[shared], where[shared], marked[shared]
            key, ids, n = key, used[where], sizes[where]
            # a class may come from several batches
            order = np.lexsort((ids, key))
            key, ids, n, marked = key[order], ids[order], n[order], marked[order]
            if len(key):
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
                group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
                crowd = (np.bincount(group[new]) > CROWD) | (np.bincount(group, weights=marked) > 0)
                key, ids, n, group = key[new], ids[new], n[new], group[new]
                crowded = crowd[group]
                yield from _key_rows(key[crowded], ids[crowded], n[crowded])
                group, ids, size = group[~crowded], ids[~crowded], n[~crowded] & 0xFFFFFFFF
                pairs = []
                for step in range(1, CROWD):
                    one = np.flatnonzero(group[step:] == group[:-step])
                    two = one + step
                    fit = percent * np.maximum(size[one], size[two]) <= 100 * np.minimum(size[one], size[two])
                    pairs.append(np.stack([ids[one[fit]], ids[two[fit]]], axis=1))
                pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
                for i in range(0, len(pairs), 50_000):
                    part = pairs[i : i + 50_000]
                    empty = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([empty, pa.array(part[:, 0]), pa.array(part[:, 1]), empty], ["key", "c", "d", "n"])

    return run


def _key_rows(key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 50_000):
        s = slice(i, i + 50_000)
        empty = pa.nulls(len(key[s]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(ids[s]), empty, pa.array(n[s])], ["key", "c", "d", "n"])


def bit_sketch(shingles: np.ndarray) -> bytes:
    """One parity bit for each value of a hash; about two bits a shingle."""
    width = 64
    while width < 2 * len(shingles) and width < 1 << 20:
        width *= 2
    bits = np.bincount((mix(shingles) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance after the longer sketch is folded to the shorter one's width."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def _sketches(size: int):
    """Size, sketch and text of each class that a task meets, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch, "text"):
                sets = list(shingle_sets(data, offsets, size))
                rows = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([bit_sketch(s) for s in sets], pa.binary()),
                        pc.fill_null(batch.column(1).slice(a, b - a), ""),
                    ],
                    ["c", "n", "sketch", "text"],
                )
                # another text may have the same id
                own = []
                for s, c in zip(sets, rows.column(0).to_pylist(), strict=True):
                    own.append(len(s) > 0 and c not in met and class_id(s) == c)
                    met.update([c] if own[-1] else [])
                yield rows.filter(pa.array(own, pa.bool_()))

    return run


def _near_enough(percent: int):
    """Pairs whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            keep = [sketch_distance(p, q) <= max_difference(m + n, percent) for p, q, m, n in zip(sa, sb, na, nb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(size: int, percent: int):
    """Pairs whose texts have the asked similarity; verifies each exactly."""

    def one(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return next(shingle_sets(raw, np.array([0, len(raw)]), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(maxsize=64)(one)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = cached(ta.as_py()), cached(tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_shingles(docs: DataFrame, size: int, n_docs: int):
    """(hashes, counts) of the most frequent shingles of a bounded sample."""
    step = max(1, n_docs // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    rows = (
        sample.select("text")
        .mapInArrow(_sample_counts(size), "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where("n >= 4")
        .orderBy(F.desc("n"), "shingle")
        .limit(COMMON)
        .toPandas()
    )
    shingle, count = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], count[order]


def _without_spare(rows: DataFrame) -> DataFrame:
    """Rows (key, c, n) of crowded blocks, less each class's spare keys: those
    of the most crowded blocks, in one order for all classes."""
    counted = rows.join(rows.groupBy("key").agg(F.count("*").alias("crowd")), "key")
    family = F.shiftrightunsigned("key", 43)  # see _keys_of_band; packing took 16 bits off
    band = F.shiftrightunsigned(family, 1)
    size = F.col("n").bitwiseAND(F.lit(0xFFFFFFFF))
    own = F.floor((F.length(F.bin(size)) + 1) / 2)
    spare = F.when(family % 2 == 1, 0).when(band == F.pmod(own, F.lit(16)), F.shiftright("n", 32).bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftright("n", 48))
    place = F.row_number().over(Window.partitionBy("c", family).orderBy(F.desc("crowd"), "key"))
    return counted.withColumn("place", place).where(F.col("place") > spare).select("key", "c", size.alias("n"))


def _compared(percent: int):
    """Pairs of a crowded block that are in different components, fit in size
    and are not ruled out by their bit sketches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c", kind="stable")
        i, j = (int(rows[x].iloc[0]) for x in ("i", "j"))
        c, n, root, block = (rows[x].to_numpy(np.int64) for x in ("c", "n", "root", "block"))
        sketches = [np.frombuffer(x, np.uint64) for x in rows["sketch"]]
        width = min(len(x) for x in sketches)
        # folded to one width, distances are still lower bounds
        bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])
        out = []
        for x in np.flatnonzero(block == i).tolist():
            y = np.flatnonzero((block == j) & (root != root[x]) & (percent * np.maximum(n, n[x]) <= 100 * np.minimum(n, n[x])))
            if i == j:
                y = y[y > x]
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
            for k in y[apart <= (n[y] + n[x]) * (100 - percent) // (100 + percent)].tolist():
                out.append((min(c[x], c[k]), max(c[x], c[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _still_apart(apart: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) across components inside crowded blocks; a block
    with very many members is compared in parts of bounded size."""
    parts = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    rows = apart.join(members.select("c", "sketch"), "c")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.select("key", "i", "j", "block", "c", "n", "root", "sketch").groupBy("key", "i", "j").applyInPandas(_compared(percent), "a long, b long").distinct()


def one_of_each_class(members: DataFrame) -> DataFrame:
    """One row of each class.  A repeated id brings its class once for each task
    that reads it, and every join on classes would multiply these rows."""
    place = F.row_number().over(Window.partitionBy("c").orderBy("copy"))
    repeats = stored(members.select("c", "copy", place.alias("place")).where("place > 1").select("copy"), "jaccard-repeats")
    return members if repeats.isEmpty() else stored(members.join(repeats, "copy", "left_anti"), "jaccard-members")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sized = stored(docs.mapInArrow(_sets(size), "doc_id long, n_shingles long, class_id long"), "jaccard-sets")
    classes = sized.where("class_id is not null and doc_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("first_id"))
    common = spark.sparkContext.broadcast(common_shingles(docs, size, sized.count()))
    parts = shuffle_partitions(spark)
    packed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_packed_keys(size, percent, parts, common), "bucket long, blob binary")
    shared = stored(packed.repartition(parts, "bucket").mapInArrow(_shared_keys(percent), "key long, c long, d long, n long"), "jaccard-keys")
    few = shared.where("key is null").select(F.col("c").alias("a"), F.col("d").alias("b"))
    many = stored(_without_spare(shared.where("key is not null").select("key", "c", "n").distinct()), "jaccard-crowded")

    # the texts of all classes that share a block
    wanted = few.select("a").union(few.select("b")).union(many.select("c")).distinct().toDF("c")
    wanted = stored(wanted.join(classes, F.col("c") == F.col("class_id")).select("c", F.col("first_id").alias("doc_id")), "jaccard-wanted")
    if wanted.count() <= WANTED_IDS:
        wanted = F.broadcast(wanted)
    one_each = docs.join(wanted, "doc_id").select("c", "text")
    members = one_each.mapInArrow(_sketches(size), "c long, n long, sketch binary, text string")
    members = one_of_each_class(stored(members.withColumn("copy", F.monotonically_increasing_id()), "jaccard-members", "zstd"))

    def check(pairs: DataFrame) -> DataFrame:
        left = members.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = members.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        near = pairs.join(left, "a").join(right, "b").mapInArrow(_near_enough(percent), "a long, b long")
        texts_a = members.select(F.col("c").alias("a"), F.col("text").alias("ta"))
        texts_b = members.select(F.col("c").alias("b"), F.col("text").alias("tb"))
        return near.join(texts_b, "b").join(texts_a, "a").mapInArrow(_verified(size, percent), "a long, b long")

    fits = f"{percent} * greatest(n, m) <= 100 * least(n, m)"
    # a block's centre: the class that is in most blocks, as an original is among its copies
    degrees = many.groupBy("c").agg(F.count("*").alias("degree"))
    ranked = many.join(degrees, "c")
    best = ranked.groupBy("key").agg(F.max(F.struct("degree", "c", "n")).alias("top"))
    stars = (
        ranked.join(best, "key")
        .select(F.col("top.c").alias("d"), "c", F.col("top.n").alias("m"), "n")
        .where(f"c <> d and {fits}")
        .select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
    )
    tried = stored(stars.union(few).distinct(), "jaccard-pairs")
    links = stored(check(tried), "jaccard-links")
    roots = connected_components(links)
    # crowded blocks whose members are still apart
    placed = many.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    apart = stored(placed.select("key", "c", "n", "root").join(split.select("key", "members"), "key"), "jaccard-apart")
    if not apart.isEmpty():
        more = stored(check(_still_apart(apart, members, percent).join(tried, ["a", "b"], "left_anti")), "jaccard-links")
        roots = connected_components(links.union(more))

    ids = roots.join(classes, F.col("node") == F.col("class_id"))
    # the smallest id of a component, for each of its classes
    firsts = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = roots.join(firsts, "root").select(F.col("node").alias("class_id"), "component_id")
    of_class = classes.join(by_class, "class_id", "left").select("class_id", F.coalesce("component_id", "first_id").alias("component_id"))
    return sized.join(of_class, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
