"""Repeated lines and sentences: all but the earliest are removed.

A text is cut into units at every line end and after each sentence (end
mark and white space), whatever their number of words.  A line of one
sentence is a unit with its line end; in a line of several, each sentence
is one and the line end stays.  Pieces without a word belong to the
sentence after them, or to the last one of the line.  Units are digested
(128 bits over the case-folded words, so punctuation and spacing don't
matter; a line without words over its other characters) and the digests
are grouped over the whole corpus.  The earliest occurrence stays, ranked
by doc_id (null first), text hash and offset; the others are removed.
Each row keeps the byte offsets, in the original text, of what was removed.

A line of under ``min_words`` words is compared with whole lines, a
sentence of so few inside a longer line with such sentences; longer ones
are compared with both.  Any end mark before white space ends a sentence,
that of an abbreviation too.  Blank lines stay.  Rows that repeat a
document (same id and text) get the same result.  Null texts stay null;
other columns pass through (result columns of the same name are replaced).

The earliest occurrence is an aggregate with map-side combine.  Each
unit meets it in a join on the digest.  A digest that stands for more than
one in ``HEAVY`` of all units is heavy; there are fewer than ``HEAVY`` of
these, whatever the corpus, so they are broadcast and their units stay where
they are.  The other units move once, a narrow row each, and none of their
digests is more than that share of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeromart.llm.common import stored, text_chunks
from aeromart.llm.hashing import U, alnum_word_bytes, made_once, mix, Powers, running, spaced_word_bytes, span_hashes, word_spans

#: A digest of more than this part of all units is heavy; so fewer digests than this are.
HEAVY = 10_000
#: Added to the digests of short lines and of lines without words, which only meet their like.
SHORT_LINE, NO_WORDS = U(0x8CB92BA72F3D8DD7), U(0xD6E8FEB86659FD93)


def unit_spans(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the units of the texts of a chunk, and whether
    each is a whole line; ``starts`` are the word starts.  Blank lines are
    units too."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    is_end = (data == 46) | (data == 33) | (data == 63)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    follows = np.append(blank[1:], True)
    text_ends = offsets[1:][offsets[1:] > offsets[:-1]]
    hard = np.union1d(np.flatnonzero(data == 10) + 1, text_ends)
    cuts = np.union1d(np.flatnonzero(is_end & follows) + 1, hard)
    before = np.searchsorted(starts, cuts)
    ends = cuts[(np.diff(before, prepend=0) > 0) | np.isin(cuts, hard)]
    begins = np.concatenate([[0], ends[:-1]])
    worded = np.diff(np.searchsorted(starts, ends), prepend=0) > 0
    line = np.searchsorted(hard, begins, side="right")
    sentences = np.bincount(line, weights=worded, minlength=len(hard)).astype(np.int64)
    # without the wordless rest of a line, which goes to the sentence before it
    own = worded | (sentences[line] == 0)
    begins, ends, line = begins[own], ends[own], line[own]
    whole = sentences[line] <= 1
    last = np.append(line[1:] != line[:-1], True)
    filled = np.maximum.accumulate(np.where(blank, 0, np.arange(1, n + 1)))
    line_ends = hard[line]
    return begins, np.where(whole, line_ends, np.where(last, filled[line_ends - 1], ends)), whole


def _digests(words: np.ndarray, first: np.ndarray, last: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each run [first, last) of word hashes."""
    up, down = made_once("powers", Powers).get(len(words) + 1)
    digests = []
    for w in (words, mix(words + U(0x2545F4914F6CDD1D))):
        sums = np.zeros(len(w) + 1, U)
        np.cumsum(w * up[: len(w)], out=sums[1:])
        digests.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U) + salt))
    return digests


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch, "text"):
                starts, ends, _ = word_spans(data, offsets, alnum_word_bytes())
                sums = running(data, fold_case=True)
                lo, hi, whole = unit_spans(data, offsets, starts)
                first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
                salt = np.where(whole & (last - first < min_words), SHORT_LINE, U(0))
                digests = _digests(span_hashes(sums, starts, ends), first, last, salt)
                keep = last > first
                # lines of other characters only
                bare = np.flatnonzero(~keep)
                if len(bare):
                    starts, ends, _ = word_spans(data, offsets, spaced_word_bytes())
                    first, last = np.searchsorted(starts, lo[bare]), np.searchsorted(starts, hi[bare])
                    for d, other in zip(digests, _digests(span_hashes(sums, starts, ends), first, last, np.full(len(bare), NO_WORDS)), strict=True):
                        d[bare] = other
                    keep[bare] = last > first
                lo, hi, digests = lo[keep], hi[keep], [d[keep] for d in digests]
                doc = np.searchsorted(offsets, lo, side="right") - 1
                at = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(lo - offsets[doc]),
                        pa.array(hi - offsets[doc]),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                    ],
                    ["doc_id", "text_hash", "start", "end", "d1", "d2"],
                )

    return run


def _cut(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at).to_pylist(), strict=True):
                text = text.as_py()
                if spans and text is not None:
                    raw, kept, at = text.encode(), [], 0
                    for s in sorted((x["start"], x["end"]) for x in spans):
                        kept.append(raw[at : s[0]])
                        at = s[1]
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def remove_repeated_units(docs: DataFrame, min_words: int = 5, heavy: int = HEAVY) -> DataFrame:
    """``docs`` with repeated units cut from ``text``; adds ``removed`` (the
    cut spans: start, end in bytes of the original text, and the doc_id
    that keeps the unit) and ``n_removed``."""
    docs = docs.drop("removed", "n_removed")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    units = stored(keyed.mapInArrow(_units(min_words), "doc_id long, text_hash long, start long, end long, d1 long, d2 long"), "lines-units")
    place = F.struct("doc_id", "text_hash", "start")
    repeated = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    is_heavy = F.col("n") * heavy > units.count()
    digest = ["d1", "d2"]
    # fewer than ``heavy`` rows; all parts below share the aggregate's one exchange
    marked = units.join(F.broadcast(repeated.where(is_heavy).select(*digest, "first")), digest, "left")
    rare = marked.where("first is null").drop("first").join(repeated.where(~is_heavy).select(*digest, "first"), digest)
    found = marked.where("first is not null").unionByName(rare)
    later = found.where(~place.eqNullSafe(F.col("first")))
    spans = later.groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", F.col("first.doc_id").alias("kept_in")))).alias("removed")
    )
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(
        spans, F.col("doc_id").cast("long").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2")), "left"
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kept_in:bigint>>")
    rows = joined.select(*docs.columns, F.coalesce("removed", none).alias("removed"))
    schema = T.StructType(rows.schema.fields)
    cut = rows.mapInArrow(_cut(rows.columns.index("text"), rows.columns.index("removed")), schema)
    return cut.withColumn("n_removed", F.size("removed"))
