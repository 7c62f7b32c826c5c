"""Token ids as length-delimited binary records.

A shard file holds one record a document, in ascending doc_id order:

    length of the payload   8 bytes, little-endian
    checksum of the length  4 bytes
    payload                 doc_id (8 bytes), flags (1 byte), then the ids
    checksum of the payload 4 bytes

Checksums are CRC-32, masked (rotated by 15 bits, plus a constant) so that
checksums of data that holds checksums stay sound.  Flag 1: the id is null;
flag 2: ids take two bytes (vocabularies below 65,536) instead of four.
The index file beside it has for each record its doc_id, byte offset and
number of ids (8 bytes each), so that a reader can fetch records in any
order.

Shards are numbered by id range and named after the attempt that wrote
them; only the shards of finished tasks are in the manifest table, so a
lost executor or a second attempt leaves nothing half-written in it.

Texts are encoded by the ``tokenizers`` library.  Its pre-tokenizer never
merges across word borders, so a task cuts texts into words (numpy, over
whole chunks), has the library encode each distinct word once and joins
the words' ids; a document with characters beyond the tables of the word
cutter, or with the string of an added token, is handed to the library whole.
So ids are those of the library's ``encode`` on the loaded file, which takes
such a string for its token.

Null texts count as empty (their record holds the end id alone); null ids
come first; repeated ids keep a record each, by text hash.  Ranges are of
id, text hash and row, so the rows of one id can be many shards.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.common import shuffle_partitions, stored, text_chunks
from aeromart.llm.hashing import U, made_once, running, span_hashes
from aeromart.session import shared_scratch_path

HEAD, CHECK, BODY = "<Q", "<I", "<qB"
HEAD_SIZE, CHECK_SIZE, BODY_SIZE = 8, 4, 9
NULL_ID, TWO_BYTES = 1, 2
LETTER, NUMBER, OTHER, SPACE, BEYOND = range(5)
KNOWN_WORDS = 1_500_000  # words that a task keeps the ids of
TABLE = 1 << 22


def masked_checksum(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack(CHECK, (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    head = struct.pack(HEAD, len(payload))
    return head + masked_checksum(head) + payload + masked_checksum(payload)


def read_frames(stream) -> Iterator[bytes]:
    """Payloads of a shard; a damaged record raises."""
    while head := stream.read(HEAD_SIZE):
        if len(head) < HEAD_SIZE or stream.read(CHECK_SIZE) != masked_checksum(head):
            raise ValueError("damaged record length")
        payload = stream.read(struct.unpack(HEAD, head)[0])
        if stream.read(CHECK_SIZE) != masked_checksum(payload):
            raise ValueError("damaged record")
        yield payload


def open_path(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _classes() -> np.ndarray:
    """Class of each code point below U+3000; unassigned ones are beyond."""
    spaces = {*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287}
    table = np.full(0x3001, BEYOND, np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        table[c] = SPACE if c in spaces else {"L": LETTER, "N": NUMBER}.get(kind[0], BEYOND if kind == "Cn" else OTHER)
    return table


def word_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokenizer words of the texts start, and the
    rows (texts) that hold characters beyond the tables.

    The words are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    table = made_once("classes", _classes)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at, np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = padded[at].astype(np.int32)
    point = lead.copy()
    two = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0))
    point[two] = ((lead[two] & 0x1F) << 6) | (padded[at[two] + 1] & 0x3F)
    three = np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
    point[three] = ((lead[three] & 0x0F) << 12) | ((padded[at[three] + 1].astype(np.int32) & 0x3F) << 6) | (padded[at[three] + 2] & 0x3F)
    point[lead >= 0xF0] = 0x3000
    kind = table[np.minimum(point, 0x3000)]
    n = len(at)
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, offsets)] = True
    text_start, text_end = first[:n], first[1:].copy()
    text_end[-1] = True
    before = np.concatenate([[BEYOND], kind[:-1]]).astype(np.uint8)
    after_blank = np.concatenate([[False], point[:-1] == 32])
    start = (kind != before) & ~((kind != SPACE) & after_blank)
    # the last of several spaces before a word stands alone or joins the word
    space = kind == SPACE
    word_next = np.concatenate([~space[1:], [False]]) & ~text_end
    start |= space & (before == SPACE) & word_next
    start |= text_start
    # contractions are words when an apostrophe starts one
    mark = np.flatnonzero(start & (point == 39))
    if len(mark):
        ends = np.flatnonzero(text_end)
        last = ends[np.searchsorted(ends, mark)]  # last character of the mark's text
        wide = np.concatenate([point, [0, 0, 0]])
        x, y = np.where(mark + 1 <= last, wide[mark + 1], 0), np.where(mark + 2 <= last, wide[mark + 2], 0)
        short = np.isin(x, [ord(c) for c in "stmd"])
        long = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for chosen, size in ((mark[short], 2), (mark[long], 3)):
            for k in range(1, size):
                start[chosen + k] = False
            follow = chosen + size
            start[follow[follow < n]] = True
    beyond = np.unique(np.searchsorted(offsets, at[kind == BEYOND], side="right") - 1)
    return at[start], beyond


class WordEncoder:
    """Ids of whole texts; keeps the ids of words already seen."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]  # the library cuts them out before words
        self.forget()

    def with_special(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows of a chunk that hold the string of an added token."""
        raw, at = data.tobytes(), []
        for token in self.special:
            place = raw.find(token)
            while place >= 0:
                at.append(place)
                place = raw.find(token, place + 1)
        return np.unique(np.searchsorted(offsets, np.array(at, np.int64), side="right") - 1)

    def forget(self) -> None:
        self.keys = np.zeros(TABLE, np.uint64)  # open addressing by word hash
        self.rows = np.full(TABLE, -1, np.int64)
        self.known = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word hash, or -1."""
        slot = (hashes & U(TABLE - 1)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.rows[slot], -2)
        out[(out == -2) & (self.rows[slot] < 0)] = -1
        open_ = np.flatnonzero(out == -2)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (TABLE - 1)
            at = slot[open_]
            row = np.where(self.rows[at] < 0, -1, np.where(self.keys[at] == hashes[open_], self.rows[at], -2))
            out[open_] = row
            open_ = open_[row == -2]
        return out

    def enter(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        slot = (hashes & U(TABLE - 1)).astype(np.int64)
        while len(hashes):
            free = self.rows[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(slot), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.rows[slot[take]] = hashes[take], rows[take]
            hashes, rows, slot = hashes[~take], rows[~take], (slot[~take] + 1) & (TABLE - 1)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words end to end, number of ids of each)."""
        if all(w[:1] == " " and w[1:].isalpha() for w in words):
            # words of a space and letters stay apart when they are joined: one call for all
            e = self.tokenizer.encode("".join(words), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            if len(of) and of[-1] == len(words) - 1:
                return np.array(e.ids, np.uint32), np.bincount(of, minlength=len(words))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((x for ids in found for x in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        plain = np.array([w[:1] == " " and w[1:].isalpha() for w in words], bool)
        for part in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for i in range(0, len(part), 20_000):
                chosen = part[i : i + 20_000]
                new, sizes = self.encode_words([words[k] for k in chosen.tolist()])
                at, n = int(self.starts[self.known]), self.known
                while at + len(new) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                while n + len(chosen) + 1 > len(self.starts):
                    self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.ids[at : at + len(new)] = new
                self.starts[n + 1 : n + 1 + len(chosen)] = at + np.cumsum(sizes)
                self.enter(hashes[chosen], np.arange(n, n + len(chosen)))
                self.known += len(chosen)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk."""
        if self.known > KNOWN_WORDS:
            self.forget()
        starts, beyond = word_borders(data, offsets)
        n = len(offsets) - 1
        if len(starts):
            ends = np.append(starts[1:], len(data))
            hashes = span_hashes(running(data), starts, ends)
            row = self.find(hashes)
            new = np.flatnonzero(row < 0)
            if len(new):
                if len(new) + self.known > TABLE * 3 // 4:  # one very long text
                    return [self.whole(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                fresh, first = np.unique(hashes[new], return_index=True)
                raw = data.tobytes()
                spans = zip(starts[new[first]].tolist(), ends[new[first]].tolist(), strict=True)
                self.learn(fresh, [raw[a:b].decode("utf-8", "replace") for a, b in spans])
                row[new] = self.find(hashes[new])
            lo = self.starts[row]
            size = self.starts[row + 1] - lo
            total = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(total[-1]) + np.repeat(lo - total[:-1], size)
            ids = self.ids[take]
            cuts = total[np.searchsorted(starts, offsets)]
        else:
            ids, cuts = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.union1d(beyond, self.with_special(data, offsets)).tolist():
            out[i] = self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        return out


def _written(folder: str, tokenizer_path: Callable[[], str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name, encoder, out, index = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex[:12]}", None, None, []
        at = tokens = 0
        for batch in batches:
            if batch.num_rows and out is None:
                system, path = open_path(name)
                out = system.open_output_stream(f"{path}.rec")
                encoder = made_once(f"words {tokenizer_path()}", lambda: WordEncoder(tokenizer_path()))
                narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16
            for a, b, data, offsets in text_chunks(batch, "text"):
                for doc_id, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(data, offsets), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    flags = (NULL_ID if doc_id is None else 0) | (TWO_BYTES if narrow else 0)
                    record = frame(struct.pack(BODY, doc_id or 0, flags) + ids.astype("<u2" if narrow else "<u4").tobytes())
                    index.append((doc_id or 0, at, len(ids)))
                    out.write(record)
                    at += len(record)
                    tokens += len(ids)
        if out is not None:
            out.close()
            with system.open_output_stream(f"{path}.idx") as side:
                side.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in ((shard, pa.int64()), (name, pa.string()), (len(index), pa.int64()), (tokens, pa.int64()), (at, pa.int64()))],
                ["shard", "name", "n_records", "n_tokens", "n_bytes"],
            )

    return run


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as unsigned 32-bit integers) of a record."""
    doc_id, flags = struct.unpack_from(BODY, payload)
    ids = np.frombuffer(payload, "<u2" if flags & TWO_BYTES else "<u4", offset=BODY_SIZE)
    return None if flags & NULL_ID else doc_id, ids.astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer_path: Callable[[], str], end_id: int = 0) -> DataFrame:
    """Write ``docs`` (doc_id, text) as record shards under ``folder``, which
    all executors must reach; returns the manifest: shard, name (without
    .rec and .idx), n_records, n_tokens, n_bytes."""
    parts = shuffle_partitions(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(parts, "doc_id", "h", "row")
        .sortWithinPartitions("doc_id", "h", "row")
        .select("doc_id", "text")
    )
    schema = "shard long, name string, n_records long, n_tokens long, n_bytes long"
    return stored(ordered.mapInArrow(_written(folder, tokenizer_path, end_id), schema), "records-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
            system, path = open_path(name)
            rows, start = [], base
            with system.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as stream:
                for payload in read_frames(stream):
                    doc_id, ids = payload_ids(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) >= 20_000:
                        yield _digest_batch(rows)
                        rows = []
            yield _digest_batch(rows)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read every shard back: doc_id, start (ids before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = manifest.select("name", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"))
    return based.repartition(shuffle_partitions(spark)).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_record(name: str, index_row: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard by its place in the index (a shuffled read)."""
    system, path = open_path(name)
    with system.open_input_file(f"{path}.idx") as side:
        _, at, _ = struct.unpack("<qqq", side.read_at(24, 24 * index_row))
    with system.open_input_file(f"{path}.rec") as stream:
        stream.seek(at)
        return payload_ids(next(read_frames(stream)))


def scratch_folder(spark) -> str:
    return shared_scratch_path(spark, "records")


def make_folder(path: str) -> str:
    system, inner = open_path(path)
    system.create_dir(inner, recursive=True)
    return path
