"""Vector codes and hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeromart.llm import codes, hardnegatives, metrictree

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, rank int, row long, square double"
EXTRA = ("c", 1, 2, 3, 4.0)  # columns whose names the results use
NAN, INF = float("nan"), float("inf")


def vectors(n=260, size=32, seed=5):
    """Clustered rows with copies, ties, nulls and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.2, (6, size))
    m = (centres[r.integers(0, 6, n)] + r.normal(0, 0.08, (n, size))) * r.choice([0.5, 1.0, 1.0, 2.0], n)[:, None]
    m[40:90] = m[3]  # one hot vector
    m[100:104] = -m[3]
    m[104] = 0
    rows = [(i, [float(x) for x in v], None if i % 31 == 30 else int(i % 4)) for i, v in enumerate(m.astype(np.float32))]
    rows += [rows[7], rows[50], rows[50]]  # repeated rows, one of them an anchor
    rows += [(7, rows[9][1], 3), (None, rows[3][1], 1), (None, rows[11][1], None)]  # an id with two vectors, no id
    rows += [(900, None, 1), (950, [*rows[0][1][:-1], None], 1), (1000, [*rows[0][1][:-1], NAN], 1), (1050, [*rows[0][1][:-1], -INF], 1), (1100, [1.0] * 5, 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def sound(rows, size=32):
    return [r for r in rows if r[1] is not None and len(r[1]) == size and all(x is not None and np.isfinite(x) for x in r[1])]


def integers(rows):
    return np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 256).astype(np.int64)


# ------------------------------------------------------------------ trees
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
@pytest.mark.parametrize("kind", ["spread", "hot", "grid", "equal"])
def test_owners_of_a_tree_are_the_nearest_entries(n, kind):
    r = np.random.default_rng(n)
    points = np.floor(r.normal(0, 40, (n, 3))).astype(np.int64)
    if kind == "hot":
        points[: n // 2] = points[0]
    if kind == "grid":
        points //= 30  # many ties
    if kind == "equal":
        points[:] = points[0]
    entries = points[r.integers(0, n, 20)]  # equal entries too
    tree = metrictree.build_tree(points)
    assert sorted(tree.order) == list(range(n))
    nearest, sums, counts = metrictree.owners(tree, points, entries)
    expected = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == expected).all() and (counts == np.bincount(expected, minlength=20)).all()
    for e in range(20):
        assert (sums[e] == points[expected == e].sum(axis=0)).all()


def test_balls_hold_their_points_and_cache_their_sums():
    points = np.floor(np.random.default_rng(1).normal(0, 40, (900, 4))).astype(np.int64)
    tree = metrictree.build_tree(points)
    for i in range(len(tree.lo)):
        own = points[tree.order[tree.lo[i] : tree.hi[i]]]
        assert (own.sum(axis=0) == tree.sums[i]).all()
        assert np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        below = tree.child[tree.first[i] : tree.first[i + 1]]
        assert len(below) in (0, 2)
        if len(below):
            assert sorted((tree.lo[b], tree.hi[b]) for b in below)[0][0] == tree.lo[i]
            assert sum(tree.hi[b] - tree.lo[b] for b in below) == tree.hi[i] - tree.lo[i]
    assert len(tree.lo) > 8


def test_anchors_own_their_nearest_points():
    points = np.random.default_rng(2).normal(0, 1, (300, 3))
    owned = metrictree.anchors(points, 17)
    assert sorted(np.concatenate(owned)) == list(range(300)) and len(owned) == 17
    places = np.array([points[0], *[points[o[-1]] for o in owned[1:]]])  # an anchor is its own last point
    nearest = ((points[:, None] - places[None]) ** 2).sum(axis=2)
    for a, own in enumerate(owned):
        assert np.allclose(nearest[own, a], nearest[own].min(axis=1))


# ------------------------------------------------------------------ codes
def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(sound(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = integers(rows).reshape(len(rows), parts, -1)
    books = m[:entries].transpose(1, 0, 2).copy()

    def assigned():
        return np.stack([((m[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = m[near[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    near = assigned()
    error = sum(((m[:, p] - books[p][near[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return rows, ["".join(f"{i:02x}" for i in x) for x in near], error, books


@pytest.mark.parametrize("block", [40, 4096])
def test_codes_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    given = vectors()
    found, books = codes.compress_vectors(table(spark, given))
    rows, code, error, expected = brute_codes(given)
    assert (books == expected).all()
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in found.collect()), key=str)
    assert got == sorted(zip([r[0] for r in rows], [r[2] for r in rows], code, error.tolist(), strict=True), key=str)
    totals = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        totals[r[2]] = totals.get(r[2], 0) + e
    summed = codes.with_label_error(found).collect()
    assert len(summed) == len(rows) and None in totals
    assert all(r.label_error == totals[r.label] for r in summed)


def test_codes_of_few_rows_and_of_none(spark):
    given = vectors()[:5]
    found, books = codes.compress_vectors(table(spark, given))
    assert books.shape == (16, 5, 2) and {r.error for r in found.collect()} == {0}
    none, books = codes.compress_vectors(table(spark, [(1, None, 1)]))
    assert books is None and codes.with_label_error(none).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress_vectors(table(spark, [(1, [1.0] * 18, 1)]))
    with pytest.raises(ValueError, match="too large"):
        codes.compress_vectors(table(spark, [(1, [1e9] * 16, 1)]))


# ------------------------------------------------------------------ hard negatives
def brute_negatives(rows, every=50):
    rows = [r for r in sound(rows) if r[2] is not None]
    m = integers(rows)
    out = []
    for i, (vec_id, _, label) in enumerate(rows):
        if vec_id is None or vec_id % every:
            continue
        scores = (m @ m[i]).tolist()
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-scores[j], rows[j][0] is None, rows[j][0] or 0))
        for p in [j for j in order if rows[j][2] == label][:5]:
            fits = [j for j in order if rows[j][2] != label and 50 * scores[p] <= 100 * scores[j] <= 95 * scores[p]]
            out += [(vec_id, rows[p][0], k + 1, rows[j][0], scores[p], scores[j]) for k, j in enumerate(fits[:3])]
    return out


@pytest.mark.parametrize(("bucket", "block"), [(8192, 512), (17, 3)])
def test_hard_negatives_equal_brute_force(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(hardnegatives, "ANCHOR_ROWS", block)
    given = vectors()
    got = hardnegatives.mine_hard_negatives(table(spark, given), F.col("vec_id") % 10 == 0).collect()
    expected = brute_negatives(given, 10)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert len(expected) > 40


def test_ranges_keep_every_row_that_can_score_enough():
    r = np.random.default_rng(3)
    m = np.floor(np.concatenate([r.normal(0, 50, (200, 6)), r.normal(0, 5, (200, 6)) + r.normal(0, 200, (1, 6))])).astype(np.int64)
    batch = next(hardnegatives._buckets(6)(iter([as_batch(m)])))
    bucket = hardnegatives._Bucket(batch.rename_columns([f"b_{c}" for c in batch.schema.names]), 0, 6)
    pruned = 0
    for anchor in m[::7]:
        scores = m @ anchor
        for least in np.quantile(scores, [0.2, 0.6, 0.9, 0.99]).tolist() + [float(scores.max())]:
            kept = bucket.candidates(anchor, least)
            assert kept[scores >= least].all()
            pruned += (~kept).sum()
    assert pruned > 5000


def as_batch(m):
    import pyarrow as pa

    n = len(m)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())] * 2 + [pa.array([0] * n, pa.int64()), pa.array(m.tolist(), pa.list_(pa.int64()))], ["row", "vec_id", "label", "v"])


def test_hard_negatives_of_nothing(spark):
    assert hardnegatives.mine_hard_negatives(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    alone = [(0, [0.5] * 32, 1), (1, [0.5] * 32, 2)]  # no positive
    assert hardnegatives.mine_hard_negatives(table(spark, alone), F.col("vec_id") % 50 == 0).count() == 0
    no_anchor = [(3, [0.5] * 32, 1), (None, [0.5] * 32, 2)]
    assert hardnegatives.mine_hard_negatives(table(spark, no_anchor), F.col("vec_id") % 50 == 0).count() == 0
