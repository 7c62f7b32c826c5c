"""Removal of byte strings that an earlier document already has.

Every byte that is covered by a string of ``SPAN`` (50) bytes which also
starts in a document with a smaller doc_id is removed.  The work is that of
a suffix array cut off at 50 bytes: positions are ranked by ever longer
prefixes, a position whose prefix is unique leaves, and the others go on
until the prefix has reached 50 bytes.

* Length 16.  Every string of 50 bytes holds 35 strings of 16; the one with
  the least hash is its anchor.  The positions with one anchor form a
  region (about 18 positions), so one entry stands for them all.  Regions
  whose anchor is in one document only are unique and leave.
* Length 33.  50 bytes around an anchor reach 17 bytes to its left or to its
  right.  Regions that agree with no other one on either side leave.
* Regions.  Among the regions with one anchor those with equal bytes have
  equal ranks at 50 at all their positions: they are settled at once, only
  the smallest doc_id's stays.  If all regions of an anchor are equal,
  nothing is left.
* Length 50.  Where regions that agree so far differ (at the borders of a
  repeated passage and around edits), each position of the one document
  that stands for a region is ranked by the pair of the ranks of its first
  and its second 25 bytes.

Ranks are 64-bit hashes, so equal prefixes have equal ranks without a
global sort of all positions.  Entries travel packed by task and bucket,
sorted inside each, and the ranking is done bucket by bucket; in a task a
region that many documents of the batch share keeps one entry, the other
documents are settled there.

Null texts count as empty.  Null ids neither remove nor are removed;
rows with one id never remove from each other.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.llm.common import shuffle_partitions, stored_by, text_chunks
from aeromart.llm.hashing import Powers, U, made_once, mix, running, span_hashes

SPAN, ANCHOR = 50, 16
REACH = SPAN - ANCHOR + 1
SIDE = (SPAN - ANCHOR) // 2
ON_RIGHT = U(0x5BD1E9955BD1E995)  # marks the name of a region that agrees with another on its right
PIECE = 4 << 20  # longer texts are read in pieces (with SPAN - 1 bytes more)
CROWD = 16  # documents of a region in one batch beyond which one stands for all
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PENDING = f"{RESULT}, packed binary, settled binary, open binary"


class Regions:
    """Regions of the texts of a chunk: first and last position, anchor and
    region hashes, and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.sums = running(data)
        n = len(data)
        if n < SPAN:
            self.first = self.last = self.row = np.zeros(0, np.int64)
            self.mark, self.anchor, self.whole, self.sides = self.row, *[np.zeros(0, U)] * 3
            return
        _, down = made_once("powers", Powers).get(n + 1)
        x = mix((self.sums[ANCHOR:] - self.sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
        # the hash's upper bits, then the place: the least of a stretch names its place
        least = (x & U(0xFFFFFFFFFF000000)) | np.arange(len(x), dtype=U)
        width = 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH:
            least = np.minimum(least[: -(REACH - width)], least[REACH - width :])
        at = np.flatnonzero(np.arange(n - SPAN + 1) + SPAN <= np.repeat(offsets[1:], np.diff(offsets))[: n - SPAN + 1])
        place = (least[at] & U(0xFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        self.first, self.last = at[new], at[np.append(new[1:], True)] if len(at) else at
        self.anchor, self.whole = x[place[new]], span_hashes(self.sums, self.first, self.last + SPAN)
        self.row = np.searchsorted(offsets, self.first, side="right") - 1
        self.mark = mark = place[new]
        left = span_hashes(self.sums, np.maximum(mark - SIDE, 0), mark)
        right = span_hashes(self.sums, mark + ANCHOR, np.minimum(mark + ANCHOR + SIDE, n))
        self.sides = (left >> U(56) << U(8)) | (right >> U(56))

    def names(self) -> np.ndarray:
        """What a region is called within its document."""
        return region_names(self.anchor >> U(32), self.whole >> U(16))


def ranks_at(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Rank at 50 of positions of a text: the pair of the ranks at 25 of the
    position and of the one 25 on."""
    data, half, out = np.frombuffer(raw, np.uint8), SPAN // 2, np.zeros(len(at), U)
    for start, part, _ in pieces(data, np.array([0, len(raw)])):
        here = np.flatnonzero((at >= start) & (at < start + PIECE + SPAN))
        here = here[at[here] + SPAN <= start + len(part)]
        sums, p = running(part), at[here] - start
        one, two = span_hashes(sums, p, p + half), span_hashes(sums, p + half, p + SPAN)
        out[here] = mix(one * U(0xC2B2AE3D27D4EB4F) + two)
    return out


def region_names(anchor32: np.ndarray, whole48: np.ndarray) -> np.ndarray:
    return (whole48.astype(U) << U(16)) | (anchor32.astype(U) & U(0xFFFF))


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets) of a chunk; a very long text in several parts
    that hold each position's 50 bytes once."""
    if len(data) <= PIECE + SPAN:
        yield 0, data, offsets
    else:  # one text (and empty ones)
        row = int(np.argmax(np.diff(offsets)))
        for start in range(0, len(data) - SPAN + 1, PIECE):
            part = data[start : start + PIECE + SPAN - 1]
            own = np.where(np.arange(len(offsets)) <= row, 0, len(part))
            yield start, part, own


def pack_keys(columns: list[tuple[np.ndarray, int]], docs: np.ndarray) -> bytes:
    """Columns of unsigned integers (each with its number of bytes), and the
    doc_id of each entry by its place in a list of them."""
    used, local = np.unique(docs, return_inverse=True)
    wide = local.astype(np.uint16 if len(used) < 65536 else np.uint32)
    head = np.array([len(docs), len(used), wide.itemsize], np.int64).tobytes()
    body = [np.ascontiguousarray(np.ascontiguousarray(c, np.uint64).view(np.uint8).reshape(-1, 8)[:, :size]).tobytes() for c, size in columns]
    return b"".join([head, used.astype(np.int64).tobytes(), wide.tobytes(), *body])


def unpack_keys(blob: bytes, sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    n, m, width = np.frombuffer(blob, np.int64, 3).tolist()
    used = np.frombuffer(blob, np.int64, m, 24)
    at = 24 + 8 * m
    docs = used[np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, n, at)]
    at += n * width
    out = []
    for size in sizes:
        full = np.zeros((n, 8), np.uint8)
        full[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
        out.append(full.view(np.uint64).reshape(n))
        at += n * size
    return out, docs


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    low = hashes & U(0xFFFFFF)
    return ((low * U(buckets)) >> U(24)).astype(np.int64)


def blob_batches(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], ["bucket", "kind", "blob"]
        )


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal buckets (sorted)."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _region_blobs(buckets: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, whole, sides, doc = (np.concatenate([h[i] for h in held]) for i in range(4))
        bucket = bucket_of(anchor, buckets)
        order = np.lexsort((doc, whole, anchor, bucket))
        anchor, whole, sides, doc, bucket = anchor[order], whole[order], sides[order], doc[order], bucket[order]
        same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])])
        keep = ~(same & np.concatenate([[False], doc[1:] == doc[:-1]]))
        anchor, whole, sides, doc, bucket, same = anchor[keep], whole[keep], sides[keep], doc[keep], bucket[keep], same[keep]
        group = np.cumsum(~same) - 1
        crowded = (np.bincount(group)[group] > CROWD) & same  # all but the smallest document's
        rows = []
        if crowded.any():
            names, docs = region_names(anchor[crowded] >> U(32), whole[crowded] >> U(16)), doc[crowded]
            for i in range(0, len(names), 200_000):
                part = slice(i, i + 200_000)
                rows.append((int(names[i] % U(buckets)), 1, pack_keys([(names[part], 8)], docs[part])))
            anchor, whole, sides, doc, bucket = anchor[~crowded], whole[~crowded], sides[~crowded], doc[~crowded], bucket[~crowded]
        rows += [(b, 0, pack_keys([(anchor[s] >> U(32), 4), (whole[s] >> U(16), 6), (sides[s], 2)], doc[s])) for b, s in by_bucket(bucket)]
        yield from blob_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, data, offsets in text_chunks(batch, "text", PIECE // 2):
                for _, part, own in pieces(data, offsets):
                    r = Regions(part, own)
                    held.append((r.anchor, r.whole, r.sides, ids[a + r.row]))
                    n += len(r.row)
                    if n >= 2_000_000:
                        yield from flush(held)
                        held, n = [], 0
        if n:
            yield from flush(held)

    return run


def doc_blobs(docs: np.ndarray, names: np.ndarray, is_open: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task found, packed by bucket of the document."""
    bucket = bucket_of(mix(docs.view(np.uint64)), buckets)
    order = np.argsort(bucket, kind="stable")
    docs, names, is_open, bucket = docs[order], names[order], is_open[order], bucket[order]
    yield from blob_batches([(b, 0, pack_keys([(names[s], 8), (is_open[s], 1)], docs[s])) for b, s in by_bucket(bucket)])


def _doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: its settled and its open names."""
    parts = [unpack_keys(blob, [8, 1]) for batch in batches for blob in batch.column("blob").to_pylist()]
    if not parts:
        return
    names, is_open = (np.concatenate([p[0][i] for p in parts]) for i in range(2))
    docs = np.concatenate([p[1] for p in parts])
    order = np.lexsort((is_open, docs))
    docs, names, is_open = docs[order], names[order], is_open[order]
    cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])).tolist() + [len(docs)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = b - int(is_open[a:b].sum())
        out.append((int(docs[a]), names[a:m].tobytes(), names[m:b].tobytes()))
    for i in range(0, len(out), 5000):
        part = out[i : i + 5000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary())], ["doc_id", "settled", "open"]
        )


def in_several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which entries have a key that more than one document has."""
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    many = np.maximum.reduceat(docs, starts) != np.minimum.reduceat(docs, starts)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(many, np.diff(np.append(starts, len(keys))))
    return out


def _settled_regions(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    out = [[], [], []]
    for batch in batches:
        for bucket, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind:
                (names,), docs = unpack_keys(blob, [8])
                for x, y in zip(out, (docs, names, np.zeros(len(docs), bool)), strict=True):
                    x.append(y)
            else:
                held.setdefault(bucket, []).append(unpack_keys(blob, [4, 6, 2]))
    for bucket in list(held):
        parts = held.pop(bucket)
        anchor, whole, sides = (np.concatenate([p[0][i] for p in parts]) for i in range(3))
        doc = np.concatenate([p[1] for p in parts])
        del parts
        # anchors of one entry are unique
        order = np.argsort(anchor)
        anchor = anchor[order]
        same = anchor[1:] == anchor[:-1]
        more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        anchor, order = anchor[more], order[more]
        whole, sides, doc = whole[order], sides[order], doc[order]
        if not len(anchor):
            continue
        order = np.lexsort((doc, whole, anchor))
        anchor, whole, sides, doc = anchor[order], whole[order], sides[order], doc[order]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])])  # smallest document of a region
        firsts = np.flatnonzero(new)
        smallest = np.repeat(doc[firsts], np.diff(np.append(firsts, len(doc))))
        later = ~new & (doc != smallest)
        names = region_names(anchor, whole)
        found = [(doc[later], names[later], np.zeros(int(later.sum()), bool))]
        # of the smallest documents, those that agree with another on a side
        doc, names, anchor, sides = doc[firsts], names[firsts], anchor[firsts], sides[firsts]
        for side, flag in ((sides >> U(8), U(0)), (sides & U(0xFF), ON_RIGHT)):
            pick = in_several(anchor << U(8) | side, doc)
            found.append((doc[pick], names[pick] ^ flag, np.ones(int(pick.sum()), bool)))
        for part in found:
            for x, y in zip(out, part, strict=True):
                x.append(y)
    if out[0]:
        yield from doc_blobs(*(np.concatenate(x) for x in out), buckets)


def cover(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans [start, end): touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(new[1:], True)]


def digest(doc_id: int | None, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    starts, ends = cover(starts, ends)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return doc_id, len(raw), int((ends - starts).sum()), len(starts), kept.hexdigest()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled more than once."""
    for batch in batches:
        packed = [zlib.compress((x.as_py() or "").encode(), 3) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def named_positions(raw: bytes, settled: np.ndarray, undecided: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what the settled regions of a text cover, and of the
    runs of positions to decide in the undecided ones."""
    spans, runs = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    if len(settled) or len(undecided):
        data = np.frombuffer(raw, np.uint8)
        for start, part, own in pieces(data, np.array([0, len(raw)])):
            r = Regions(part, own)
            names = r.names()
            hit = np.isin(names, settled)
            spans.append(np.stack([r.first[hit], r.last[hit] + SPAN], axis=1) + start)
            # positions that reach SIDE bytes left of the anchor need agreement there, the others on the right
            border = np.clip(r.mark - SIDE + 1, r.first, r.last + 1)
            on_left, on_right = np.isin(names, undecided) & ~hit, np.isin(names ^ ON_RIGHT, undecided) & ~hit
            first = np.concatenate([r.first[on_left], border[on_right]])
            stop = np.concatenate([border[on_left], r.last[on_right] + 1])
            runs.append(np.stack([first, stop], axis=1)[first < stop] + start)
    span, run = np.concatenate(spans), np.concatenate(runs)
    return *cover(span[:, 0], span[:, 1]), *cover(run[:, 0], run[:, 1])


def spread(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All positions of the runs [start, stop)."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def name_list(names: bytes | None) -> np.ndarray:
    return np.frombuffer(names or b"", np.uint64)


def _first_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the documents without undecided positions; the others with
    their text, what is settled and the runs to decide."""
    for batch in batches:
        rows = []
        for doc_id, packed, done, left in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "settled", "open")), strict=True):
            raw = zlib.decompress(packed)
            starts, ends, run, stop = named_positions(raw, name_list(done), name_list(left))
            if len(run):
                rows.append((doc_id, None, None, None, None, packed, np.stack([starts, ends]).tobytes(), np.stack([run, stop]).tobytes()))
            else:
                rows.append((*digest(doc_id, raw, starts, ends), None, None, None))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 3
        names = [c.split()[0] for c in PENDING.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _rank_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rank, doc = (np.concatenate([h[i] for h in held]) for i in range(2))
            bucket = bucket_of(rank, buckets)
            order = np.lexsort((doc, rank, bucket))
            rank, doc, bucket = rank[order], doc[order], bucket[order]
            new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1])])
            rank, doc, bucket = rank[new], doc[new], bucket[new]
            yield from blob_batches([(b, 0, pack_keys([(rank[s], 8)], doc[s])) for b, s in by_bucket(bucket)])

        for batch in batches:
            for doc_id, packed, left in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "open")), strict=True):
                rank = ranks_at(zlib.decompress(packed), spread(*np.frombuffer(left, np.int64).reshape(2, -1)))
                held.append((rank, np.full(len(rank), doc_id, np.int64)))
                n += len(rank)
                if n >= 2_000_000:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _repeated_ranks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    out = []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held.setdefault(bucket, []).append(unpack_keys(blob, [8]))
    for bucket in list(held):
        parts = held.pop(bucket)
        rank, doc = np.concatenate([p[0][0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((doc, rank))
        rank, doc = rank[order], doc[order]
        firsts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        later = doc != np.repeat(doc[firsts], np.diff(np.append(firsts, len(doc))))
        out.append((doc[later], rank[later]))
    if out:
        docs, ranks = (np.concatenate([o[i] for o in out]) for i in range(2))
        yield from doc_blobs(docs, ranks, np.zeros(len(docs), bool), buckets)


def _last_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "packed", "settled", "open", "repeated"))
        for doc_id, packed, settled, left, repeated in zip(*columns, strict=True):
            raw = zlib.decompress(packed)
            starts, ends = np.frombuffer(settled, np.int64).reshape(2, -1)
            at = spread(*np.frombuffer(left, np.int64).reshape(2, -1))
            at = at[np.isin(ranks_at(raw, at), name_list(repeated))]
            rows.append(digest(doc_id, raw, np.concatenate([starts, at]), np.concatenate([ends, at + SPAN])))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``."""
    parts = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    blob = "bucket long, kind int, blob binary"

    def by_document(blobs: DataFrame, found) -> DataFrame:
        """What ``found`` tells of packed entries, one row a document."""
        told = blobs.repartition(parts, "bucket").mapInArrow(lambda batches: found(batches, parts), blob)
        return told.repartition(parts, "bucket").mapInArrow(_doc_rows, "doc_id long, settled binary, open binary")

    lists = by_document(docs.where("doc_id is not null").mapInArrow(_region_blobs(parts), blob), _settled_regions)
    packed = docs.mapInArrow(_packed, "doc_id long, packed binary")
    first = stored_by(packed.join(lists, "doc_id", "left").mapInArrow(_first_results, PENDING), "spans-first", "doc_id", parts)
    pending = first.where("packed is not null")
    repeated = by_document(pending.select("doc_id", "packed", "open").mapInArrow(_rank_blobs(parts), blob), _repeated_ranks)
    last = pending.join(repeated.select("doc_id", F.col("settled").alias("repeated")), "doc_id", "left").mapInArrow(_last_results, RESULT)
    return first.where("packed is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").union(last)
