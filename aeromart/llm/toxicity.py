"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings counts the character subsequences of length 2
and 3 that they share, each weighted by ``DECAY`` to the power of the
stretch it covers in both, so gaps and inserted characters lower the
similarity of two words but leave it high ("idi-o.t").  It is evaluated
against a few landmark strings, and the Nyström map turns those values
into features whose inner products approximate the kernel; a linear SVM
(squared hinge loss) is trained on them.

Labels come by document.  A document is a bag of words (white-space words;
spaced-out letters "i d i o t" count as one): a toxic one is marked by some
of its words, a clean one by none.  Words of labelled documents are counted
over all training rows; the words whose counts are far more frequent in
toxic documents are the positive examples (the foremost also with a
character inserted) and give the landmarks, words of clean documents are
the negative ones.  A document's margin is
its most toxic word's, and a logistic fit of the margins of labelled
documents turns it into a score.

Fitted on bounded samples: about ``fit_docs`` labelled documents for the
word counts and for the logistic fit, at most ``POSITIVES`` + ``NEGATIVES``
words.  Every document is scored whole.  Null and empty texts have no word:
they get the score of the least margin.  Repeated and null ids are scored
row by row.  Without labels of both kinds every score is the base rate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.llm.common import stored, text_chunks
from aeromart.llm.hashing import U, made_once, running, span_hashes, spaced_word_bytes, word_spans

DECAY = 0.85
SHARPNESS = 3.0
WORD_BYTES = 24  # longer words are read in overlapping stretches of this length
POSITIVES, NEGATIVES, LANDMARKS = 1500, 6000, 120
CHANGED = 60  # positive words that are also learned with a character inserted
KNOWN_WORDS = 1_000_000
PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
FLOOR = -2.0  # margin of a text without words


def cleaned(word: bytes) -> bytes:
    """Lower case, without ASCII punctuation."""
    return word.decode("utf-8", "replace").lower().encode().translate(None, PUNCTUATION)


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel of each word with each landmark, in [0, 1]: a Gaussian over the
    distance that the normalised subsequence kernel gives.

    Words of one length go together, so the recursion over the places of
    both strings runs on arrays over (word, landmark).  A landmark with
    which a word shares less than 7 of 10 of the landmark's distinct bytes,
    or 6 of 10 of its own, counts 0.
    """
    out = np.zeros((len(words), len(landmarks)))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    width = max((len(x) for x in landmarks), default=0)
    right = np.zeros((len(landmarks), width), np.uint8)
    for j, x in enumerate(landmarks):
        right[j, : len(x)] = np.frombuffer(x, np.uint8)
    right_self = np.array([self_kernel(np.frombuffer(x, np.uint8)[None])[0] for x in landmarks])
    sets, sizes = byte_sets(right), np.array([len(x) for x in landmarks])
    for length, rows in by_length.items():
        if length < 2 or length > WORD_BYTES or not landmarks:
            continue
        for k in range(0, len(rows), 2000):
            part = np.array(rows[k : k + 2000])
            left = np.frombuffer(b"".join(words[i] for i in part.tolist()), np.uint8).reshape(len(part), length)
            own = byte_sets(left)
            shared = 10 * np.bitwise_count(own[:, None] & sets[None]).astype(np.int16)
            enough = (shared >= 7 * np.bitwise_count(sets).astype(np.int16)[None]) & (shared >= 6 * np.bitwise_count(own).astype(np.int16)[:, None])
            own_self = self_kernel(left)
            w, m = np.nonzero(enough)
            for size in np.unique(sizes[m]).tolist():
                of_size = sizes[m] == size
                for p in np.array_split(np.flatnonzero(of_size), max(1, int(of_size.sum()) // 8000)):
                    x, y = w[p], m[p]
                    alike = raw_kernel(left[x], right[y, :size]) / np.sqrt(own_self[x] * right_self[y])
                    out[part[x], y] = np.exp(-2 * SHARPNESS * (1 - alike))
    return out


def byte_sets(strings: np.ndarray) -> np.ndarray:
    """The distinct bytes of each string as a 64-bit set (by the low six bits)."""
    bits = np.where(strings > 0, U(1) << (strings & 63).astype(U), U(0))
    return np.bitwise_or.reduce(bits, axis=1)


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of a[i] with b[i]; ``b`` may be padded with zeros."""
    d = np.float32(DECAY)
    n, la, lb = len(a), a.shape[1], b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    ends = [[np.where((a[i] == b[j]) & (b[j] != 0), d * d, np.float32(0)) for j in range(lb)] for i in range(la)]
    total = np.zeros(n, np.float32)
    for _ in (2, 3):
        # discounted sums of all matches that end before (i, j)
        above = [np.zeros(n, np.float32) for _ in range(lb + 1)]
        grown = []
        for i in range(la):
            row, across, new = [], np.zeros(n, np.float32), [np.zeros(n, np.float32)]
            for j in range(lb):
                value = ends_of(a[i], b[j], above[j], d)
                row.append(value)
                total += value
                across = across * d + ends[i][j]
                new.append(above[j + 1] * d + across)
            grown.append(row)
            above = new
        ends = grown
    return total


def ends_of(x: np.ndarray, y: np.ndarray, before: np.ndarray, d: np.float32) -> np.ndarray:
    return np.where((x == y) & (y != 0), before * (d * d), np.float32(0))


def self_kernel(a: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself (at least a little)."""
    return np.maximum(raw_kernel(a, a), np.float32(1e-6))


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on its active set."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], reg)
    ridge[-1] = 1e-8
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        xa, wa = x1[active], weight[active]
        h = (xa * wa[:, None]).T @ xa / weight.sum() + np.diag(ridge)
        new = np.linalg.solve(h, (xa * (wa * y[active])[:, None]).sum(axis=0) / weight.sum())
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def pieces(word: bytes) -> list[bytes]:
    """A word, or its overlapping stretches if it is long."""
    if len(word) <= WORD_BYTES:
        return [word]
    step = WORD_BYTES // 2
    return [word[i : i + WORD_BYTES] for i in range(0, len(word) - step, step)]


class Model:
    """Landmarks, their Nyström map and the SVM's weights."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float) -> None:
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.slope, self.offset = 1.0, 0.0

    def margins(self, words: list[bytes]) -> np.ndarray:
        """Decision value of each word (the largest of a long word's pieces)."""
        parts = [p for w in words for p in pieces(w)]
        values = np.clip(kernel(parts, self.landmarks) @ self.weights + self.bias, FLOOR, 1.0)
        firsts = np.cumsum([0] + [len(pieces(w)) for w in words])[:-1]
        return np.maximum.reduceat(values, firsts) if len(values) else np.zeros(0)

    def name(self) -> str:
        """Digest of what a word's margin follows from."""
        parts = [*self.landmarks, np.asarray(self.weights, float).tobytes(), repr(float(self.bias)).encode()]
        return hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in parts)).hexdigest()

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.asarray(margin, float) + self.offset)))


def inserted(word: bytes) -> list[bytes]:
    """Three variants of a word with a foreign character inside."""
    middle = len(word) // 2
    return [word[:i] + b"x" + word[i:] for i in (middle - 1, middle, middle + 1)] if len(word) >= 5 else []


def train(positive: list[bytes], negative: list[bytes], seen: np.ndarray) -> Model:
    """SVM over words; ``positive`` in order of importance, ``seen`` how often
    each was."""
    landmarks: list[bytes] = []
    for pool, upto in ((positive, LANDMARKS * 5 // 6), (negative, LANDMARKS)):
        for w in pool:
            if len(landmarks) >= upto:
                break
            if not landmarks or kernel([w], landmarks).max() < 0.8:
                landmarks.append(w)
    k = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    nystroem = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    changed = [(v, s) for w, s in zip(positive[:CHANGED], seen, strict=False) for v in inserted(w)]
    x = kernel(positive + [v for v, _ in changed] + negative, landmarks) @ nystroem
    y = np.concatenate([np.ones(len(positive) + len(changed)), -np.ones(len(negative))])
    extra = np.array([s for _, s in changed], float)
    weight = np.concatenate([seen / seen.sum(), 0.5 * extra / max(extra.sum(), 1), np.full(len(negative), 1 / max(1, len(negative)))])
    w, bias = train_svm(x, y, weight)
    return Model(landmarks, nystroem @ w, bias)


def fit_logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds of ``y`` over the margin."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(h, (x * (weight * (y - p))[:, None]).sum(axis=0) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def document_words(data: np.ndarray, offsets: np.ndarray):
    """Words of the texts of a chunk: (hashes, starts, ends, first word of each
    text), and for spaced-out letters (text, joined letters)."""
    starts, ends, firsts = word_spans(data, offsets, spaced_word_bytes())
    hashes = span_hashes(running(data, fold_case=True), starts, ends)
    spaced = []
    single = np.flatnonzero(ends - starts == 1)
    if len(single) > 2:
        doc = np.searchsorted(firsts, single, side="right") - 1
        breaks = np.flatnonzero((np.diff(single) > 1) | (np.diff(doc) > 0)) + 1
        for run in np.split(np.arange(len(single)), breaks):
            if len(run) > 2:
                spaced.append((int(doc[run[0]]), data[starts[single[run]]].tobytes()))
    return hashes, starts, ends, firsts, spaced


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, clean documents), summed by chunk."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_chunks(batch, "text", 1 << 20):
            counts: dict[bytes, list[int]] = {}
            raw, (_, starts, ends, firsts, spaced) = data.tobytes(), document_words(data, offsets)
            extra: dict[int, list[bytes]] = {}
            for d, w in spaced:
                extra.setdefault(d, []).append(w)
            starts, ends, firsts = starts.tolist(), ends.tolist(), firsts.tolist()
            for d in range(b - a):
                own = {cleaned(raw[starts[i] : ends[i]]) for i in range(firsts[d], firsts[d + 1])} | {cleaned(w) for w in extra.get(d, [])}
                for w in own:
                    if 2 <= len(w) <= WORD_BYTES:
                        counts.setdefault(w, [0, 0])[0 if toxic[a + d] else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                ["word", "toxic", "clean"],
            )


def known_words(name: str) -> dict:
    """Hashes, in order, and margins of the words that this Python worker has
    met under the model ``name``, in whichever task; another model's go."""
    known = made_once("toxicity words", dict)
    if known.get("model") != name:
        known.update(model=name, hashes=np.zeros(0, U), values=np.zeros(0))
    return known


def _margins(model: Model):
    """Replace each text by its margin; the model is a few kilobytes."""
    name = model.name()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(name)
        known_hash, known_value = known["hashes"], known["values"]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = []
            for _, _, data, offsets in text_chunks(batch, "text", 6 << 20):
                hashes, starts, ends, firsts, spaced = document_words(data, offsets)
                if len(known_hash) > KNOWN_WORDS:
                    known_hash, known_value = np.zeros(0, U), np.zeros(0)
                place = np.searchsorted(known_hash, hashes)
                fresh = np.flatnonzero(known_hash[np.minimum(place, len(known_hash) - 1)] != hashes) if len(known_hash) else np.arange(len(hashes))
                if len(fresh):
                    new, first = np.unique(hashes[fresh], return_index=True)
                    raw, pick = data.tobytes(), fresh[first]
                    values = model.margins([cleaned(raw[x:y]) for x, y in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
                    known_hash = np.concatenate([known_hash, new])
                    order = np.argsort(known_hash, kind="stable")
                    known_hash, known_value = known_hash[order], np.concatenate([known_value, values])[order]
                    known.update(hashes=known_hash, values=known_value)
                    place = np.searchsorted(known_hash, hashes)
                margin = np.full(len(offsets) - 1, FLOOR)
                if len(hashes):
                    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                    np.maximum.at(margin, doc, known_value[place])
                if spaced:
                    np.maximum.at(margin, [d for d, _ in spaced], model.margins([cleaned(w) for _, w in spaced]))
                found.append(margin)
            out = np.concatenate([np.zeros(0), *found])
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], [*names, "margin"])

    return run


def learn_toxicity(labelled: DataFrame) -> Model:
    """Model from ``labelled`` (text, toxic 0 or 1), a bounded sample (see
    ``bounded_labels``)."""
    rows = labelled.where("toxic is not null and text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    sample = stored(rows.select("text", "toxic"), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        model = Model([], np.zeros(0), FLOOR)
        model.slope, model.offset = 0.0, float(np.log((n_toxic + 0.5) / (n_clean + 0.5))) if n_toxic + n_clean else -10.0
        return model
    words = sample.mapInArrow(_word_counts, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    words = words.withColumn("ratio", ratio)
    positive = words.where((F.col("toxic") >= max(3, n_toxic // 100)) & (F.col("ratio") >= 15)).orderBy(F.desc("toxic"), "word").limit(POSITIVES).toPandas()
    clean = words.where((F.col("clean") >= 1) & (F.col("ratio") < 1.5))
    half = NEGATIVES // 2
    negative = clean.orderBy(F.desc("clean"), "word").limit(half).union(clean.orderBy(F.xxhash64("word"), "word").limit(half)).select("word").distinct().orderBy("word").toPandas()
    if not len(positive) or not len(negative):
        model = Model([], np.zeros(0), FLOOR)
        model.slope, model.offset = 0.0, float(np.log(n_toxic / n_clean))
        return model
    model = train([bytes(w) for w in positive["word"]], [bytes(w) for w in negative["word"]], positive["toxic"].to_numpy(float))
    fit = sample.mapInArrow(_margins(model), "toxic int, margin double").toPandas()
    model.slope, model.offset = fit_logistic(fit["margin"].to_numpy(), fit["toxic"].to_numpy(float), np.ones(len(fit)))
    return model


def bounded_labels(labels: DataFrame, fit_docs: int = 12_000) -> DataFrame:
    """(doc_id, toxic): about ``fit_docs`` / 2 rows of each label at most,
    chosen by a hash of the id; ids with differing labels are left out."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top").drop("top")
    counts = one.groupBy("toxic").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") * 2 / fit_docs))
    return one.join(F.broadcast(counts), "toxic").where(F.pmod(F.xxhash64("doc_id"), step) == 0).select("doc_id", "toxic")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without its text, with score and predicted added."""
    kept = docs.drop("margin", "score", "predicted")
    schema = kept.drop("text").schema.add("margin", "double")
    scored = kept.mapInArrow(_margins(model), schema)
    odds = F.lit(model.slope) * F.col("margin") + F.lit(model.offset)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("margin")
