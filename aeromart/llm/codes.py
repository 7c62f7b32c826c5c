"""Vector codes: every part of a vector becomes the number of its nearest
codebook entry, learned by exact k-means over metric trees.

Vectors are cut into ``parts`` equal consecutive parts.  The rows of a task
are taken in blocks of ``BLOCK_ROWS``; each block gets a metric tree for
each part position (``metrictree``), built once and stored with the block.
A round sends the codebooks down all trees: balls inherit the entries that
can still own a point of them, and a ball left with one entry gives its
cached sum and count.  What a round gathers is a sum and a count for each
entry, at most parts x entries rows, whatever the number of vectors.
Everything is integer arithmetic, so results don't depend on how rows are
dealt out.

Components are floor(``scale`` * x).  A codebook starts as the parts of the
``entries`` rows with the smallest ids (all rows, if fewer); rows of one id
go by vector.  A round assigns all parts (squared distance, ties to the
lower entry) and replaces each entry by the componentwise floor of the mean
of its parts; entries without a part stay.

Left out: null vectors, vectors with null or non-finite components, and
vectors of another size than the most frequent one (the smaller of two).
That size must be a multiple of ``parts``, and components so small that a
squared distance fits a long; both are errors otherwise.  Rows that repeat
an id are rows of their own; a null id comes after all others, and a null
label is a label like any other.  Other columns are not read.  An empty
table has no codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.llm.blocks import as_integers, common_size, matrix, packed, runs, sound_vector
from aeromart.llm.common import stored
from aeromart.llm.metrictree import MetricTree, build_tree, owners

BLOCK_ROWS = 4096
#: arrays of a tree, one after another for all part positions
TREE = {"order": np.int32, "lo": np.int32, "hi": np.int32, "sums": np.int64, "centre": np.float64, "radius": np.float64, "first": np.int32, "child": np.int32}


def _blocks(parts: int, size: int):
    """A row for each block: its vectors and the trees of its parts."""
    width = size // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, BLOCK_ROWS):
            values = matrix(block.column("v").combine_chunks(), size)
            trees = [build_tree(values[:, p * width : (p + 1) * width]) for p in range(parts)]
            rows = pa.StructArray.from_arrays([block.column(c).combine_chunks() for c in ("vec_id", "label")], ["vec_id", "label"])
            arrays = {name: b"".join(packed(getattr(t, name).astype(kind)) for t in trees) for name, kind in TREE.items()}
            columns = {
                "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                "vectors": pa.array([packed(values)]),
                "balls": pa.array([[len(t.lo) for t in trees]], pa.list_(pa.int32())),
                **{name: pa.array([x], pa.binary()) for name, x in arrays.items()},
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _trees(row: dict, width: int) -> Iterator[MetricTree]:
    """The trees of a stored block, part by part."""
    arrays = {name: np.frombuffer(row[name], kind) for name, kind in TREE.items()}
    n = len(row["rows"])
    at = dict.fromkeys(TREE, 0)
    for balls in row["balls"]:
        sizes = {"order": n, "lo": balls, "hi": balls, "sums": balls * width, "centre": balls * width, "radius": balls, "first": balls + 1, "child": balls - 1}
        own = {name: arrays[name][at[name] : at[name] + sizes[name]] for name in TREE}
        at = {name: at[name] + sizes[name] for name in TREE}
        own["sums"], own["centre"] = (own[x].reshape(balls, width) for x in ("sums", "centre"))
        yield MetricTree(**own)


def _block(batch: pa.RecordBatch, i: int) -> dict:
    """Row i of a batch of blocks; its rows stay an Arrow array."""
    row = {name: batch.column(name)[i].as_py() for name in (*TREE, "vectors", "balls")}
    row["rows"] = batch.column("rows")[i].values
    return row


def _gathered(codebooks: np.ndarray, size: int):
    """Sums and counts of the parts of each entry, over a whole task."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = _block(batch, i)
                values = np.frombuffer(row["vectors"], np.int64).reshape(-1, size)
                for p, tree in enumerate(_trees(row, width)):
                    _, s, c = owners(tree, values[:, p * width : (p + 1) * width], codebooks[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(counts[part, entry], pa.int64()),
                pa.array([[str(x) for x in sums[p, e]] for p, e in zip(part, entry, strict=True)], pa.list_(pa.string())),
            ],
            ["part", "entry", "n", "sums"],
        )

    return run


def refined(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after a round over all blocks."""
    parts, entries, width = codebooks.shape
    gathered = blocks.mapInArrow(_gathered(codebooks, parts * width), "part int, entry int, n long, sums array<string>")
    totals = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    out = codebooks.copy()
    for row in gathered.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # at most parts x entries
        out[row["part"], row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(width)]
    return out


def _coded(codebooks: np.ndarray, size: int):
    parts, _, width = codebooks.shape
    digits = np.array([f"{i:02x}" for i in range(codebooks.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _block(batch, i)
                values = np.frombuffer(row["vectors"], np.int64).reshape(-1, size)
                codes, error = np.empty((len(values), parts), np.int64), np.zeros(len(values), np.int64)
                for p, tree in enumerate(_trees(row, width)):
                    own = values[:, p * width : (p + 1) * width]
                    codes[:, p], _, _ = owners(tree, own, codebooks[p])
                    error += ((own - codebooks[p][codes[:, p]]) ** 2).sum(axis=1)
                text = pa.array(["".join(x) for x in digits[codes]], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [row["rows"].field("vec_id"), row["rows"].field("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"]
                )

    return run


def codebooks_digest(codebooks: np.ndarray) -> str:
    """sha256 of all components as decimal text, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, column: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """Codes of the rows of ``vectors`` (vec_id, label and ``column``) as
    (vec_id, label, code, error), and the codebooks (parts x entries x
    width; None for an empty table).  ``code`` has two hex digits a part;
    ``error`` is the vector's squared distance to its entries."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: entries must be 1 to 256")
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where(sound_vector(F.col("v")))
    rows = rows.withColumn("v", as_integers(F.col("v"), scale))
    label = dict(vectors.dtypes)["label"]
    schema = f"vec_id long, label {label}, code string, error long"
    found = common_size(rows, "v")
    if found is None:
        return spark.createDataFrame([], schema), None
    size, _, most = found
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    if size * (2 * most) ** 2 >= 2**63:
        raise ValueError("components are too large for squared distances in a long")
    rows = rows.where(F.size("v") == size)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    codebooks = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy()
    kinds = "balls array<int>, " + ", ".join(f"{name} binary" for name in TREE)
    blocks = stored(rows.mapInArrow(_blocks(parts, size), f"rows array<struct<vec_id: long, label: {label}>>, vectors binary, {kinds}"), "code-trees")
    for _ in range(rounds):
        codebooks = refined(blocks, codebooks)
    return blocks.mapInArrow(_coded(codebooks, size), schema), codebooks


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of an equal
    label, nulls together."""
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
