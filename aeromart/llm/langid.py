"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of letters (word
borders count as a space).  A text is compared with every learned language
by the out-of-place distance: for each of the text's most frequent n-grams
the difference between its rank there and in the language's profile, or
the largest possible one if the profile lacks it.  The nearest language is
predicted; ties go to the smaller name.

The score is 1 - distance / largest possible distance.  Texts that are null
or have no letter are ``und`` with score 0, and so is everything when
nothing could be learned.  Repeated rows are judged alike; null ids are
fine.  Whole texts are counted, whatever their length.

Profiles are learned from at most about ``fit_rows`` documents a language,
chosen by a hash of their ids; they are bounded by languages x ``size``
n-grams, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeromart.llm.common import stored
from aeromart.llm.hashing import made_once

UNKNOWN = "und"
MANY_LANGUAGES = 100_000  # labels up to which their counts are broadcast


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text, in no special order."""
    letter = made_once("letters", _letters)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    inside = letter[points]
    c = np.zeros(len(points) + 2, np.int64)  # a space on either side
    c[1:-1] = np.where(inside, points, 0)
    one = c[c > 0]
    two = (c[:-1] | (c[1:] << 21))[(c[:-1] > 0) | (c[1:] > 0)]
    # a border only at either end, and never just one letter between borders
    three = (c[:-2] | (c[1:-1] << 21) | (c[2:] << 42))[(c[1:-1] > 0) & ((c[:-2] > 0) | (c[2:] > 0))]
    return np.concatenate([one, two | np.int64(1 << 62), three | np.int64(-(1 << 63))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for i in range(0, len(texts), 200):
                codes, counts = np.unique(np.concatenate([gram_codes(t) for t in texts[i : i + 200]]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
                )


def learn_profiles(labelled: DataFrame, fit_rows: int = 4000, size: int = 400) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-grams sorted, rank of each n-gram in each language or -1)
    from ``labelled`` (doc_id, text, lang)."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("rows")), "langid-counts")
    if counts.count() <= MANY_LANGUAGES:  # so that the texts stay where they are
        counts = F.broadcast(counts)
    # a language's documents are thinned by hash to about fit_rows
    sample = (
        rows.join(counts, "lang")
        .where(F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.floor(F.col("rows") / fit_rows))) == 0)
        .select("lang", "text")
    )
    grams = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    table = ranked.select("lang", "gram", "place").toPandas()
    langs = sorted(table["lang"].unique().tolist())
    vocabulary = np.unique(table["gram"].to_numpy(np.int64)) if len(table) else np.zeros(0, np.int64)
    ranks = np.full((len(vocabulary), len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        ranks[np.searchsorted(vocabulary, own["gram"].to_numpy(np.int64)), j] = own["place"].to_numpy(np.int64) - 1
    return langs, vocabulary, ranks


def nearest(text: str | None, langs: list[str], vocabulary: np.ndarray, ranks: np.ndarray, size: int) -> tuple[str, float]:
    """Language of one text, and its score."""
    codes, counts = np.unique(gram_codes(text), return_counts=True) if text else (np.zeros(0, np.int64), None)
    if not len(codes) or not langs:
        return UNKNOWN, 0.0
    top = codes[np.argsort(-counts, kind="stable")[:size]]
    at = np.minimum(np.searchsorted(vocabulary, top), len(vocabulary) - 1)
    place = np.where((vocabulary[at] == top)[:, None], ranks[at], -1)
    off = np.where(place < 0, size, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)
    best = int(np.argmin(off))
    return langs[best], float(1 - off[best] / (size * len(top)))


def predict_language(docs: DataFrame, model: tuple, size: int = 400) -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(t.as_py(), *shared.value, size) for t in batch.column("text")]
            out = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)
