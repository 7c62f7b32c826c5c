"""Joins and deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeromart.llm.ann import best_of, closest, kmeans, nearest_neighbours, needed_share, traverse
from aeromart.llm.components import connected_components
from aeromart.llm.decontaminate import contaminated
from aeromart.llm import jaccard
from aeromart.llm.linededup import remove_repeated_units
from aeromart.llm.suffixdedup import remove_repeated_spans
from tests.llm import cases


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("crowd", [2, 8])
def test_jaccard_join_finds_every_link(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    docs = cases.documents(spark)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(cases.texts())}
    expected = {(i, len(sets[i]), c) for i, c in components(sets).items()}
    assert {r for r in got if r[0] is not None} == expected
    assert (None, len(sets[2]), None) in got or (None, len(sets[2]), 0) in got


@pytest.mark.parametrize("counted", ["rarest first", "a few documents"])
def test_counts_of_shingles_order_the_keys_and_lose_no_link(spark, counted, monkeypatch):
    """Whatever the counts say, down to the opposite of the truth, rows are the same."""
    true = jaccard.common_shingles

    def counts(docs, size, n_docs):
        shingle, n = true(docs, size, 1)
        return shingle, n.max(initial=0) - n

    if counted == "a few documents":
        monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 2)
    else:
        monkeypatch.setattr(jaccard, "common_shingles", counts)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(cases.documents(spark)).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(cases.texts())}
    assert {r for r in got if r[0] is not None} == {(i, len(sets[i]), c) for i, c in components(sets).items()}


@pytest.mark.parametrize("crowd", [1, 8])
def test_repeated_rows_of_near_copies_are_met_once(spark, crowd, monkeypatch):
    """Hot ids: a thousand rows of each of two near copies, over many tasks."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    base = cases.words(100, 31)
    near, far = " ".join([*base[:50], "changed", *base[51:]]), " ".join(cases.words(100, 32))
    rows = [(i, t) for i, t in ((7, " ".join(base)), (9, near), (11, far)) for _ in range(1000)]
    rows += [(9, far + " and more of it")] * 40  # an id with two texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    got = {(r.doc_id, r.component_id): r.n for r in jaccard.near_duplicates(docs).groupBy("doc_id", "component_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(7, 7): 1000, (9, 7): 1000, (9, 9): 40, (11, 9): 1000}


def test_jaccard_join_of_nothing(spark):
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_kept_keys_of_linked_sets_always_meet():
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 12, 15, 16, 17, 40, 63, 64, 65, 200]:
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            keep = max(1, int(np.ceil(0.75 * n)))
            b = np.unique(np.concatenate([a[:keep], r.integers(0, 2**63, r.integers(0, n // 8 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                weight = {int(x): int(r.integers(0, 4)) for x in np.union1d(a, b)}
                keys = [jaccard.document_keys(s, np.array([weight[int(x)] for x in s]), 75)[0] for s in (a, b)]
                assert len(np.intersect1d(*keys)) > 0


def test_sketch_distance_never_exceeds_the_difference():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], r.integers(0, 2**63, r.integers(1, 900)).astype(np.uint64)]))
        assert jaccard.sketch_distance(jaccard.bit_sketch(a), jaccard.bit_sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain_a_hub_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(60)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def spans_by_force(texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            if first.setdefault(s, i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in remove_repeated_spans(cases.documents(spark)).collect()]
    expected = spans_by_force(cases.texts())
    assert len(got) == len(expected) + 2
    for doc_id, row in got:
        if doc_id is None:
            assert row[1] == 0
        else:
            assert row == expected[doc_id], doc_id
    assert remove_repeated_spans(cases.empty(spark)).count() == 0


def test_line_dedup_keeps_the_earliest_and_the_offsets(spark):
    got = {r.doc_id: r for r in remove_repeated_units(cases.documents(spark)).collect()}
    original = dict(enumerate(cases.texts()))
    seen = {}
    for i, t in original.items():
        row = got[i]
        raw = (t or "").encode()
        gone = [raw[s["start"] : s["end"]] for s in row.removed]
        assert row.n_removed == len(gone)
        if t is None:
            assert row.text is None
            continue
        # what is cut is at its place, was seen before, and the rest is whole
        assert len(row.text.encode()) + sum(map(len, gone)) == len(raw)
        for s, piece in zip(row.removed, gone, strict=True):
            assert s["kept_in"] is None or s["kept_in"] <= i
        seen[i] = gone
    assert got[1].text == "" and got[4].n_removed == 0
    assert all(got[i].n_removed == 0 for i in (28, 29, 30, 31))
    assert {"score", "key", "n", "c"} <= set(got[0].asDict())
    assert remove_repeated_units(cases.empty(spark)).count() == 0


def test_line_dedup_of_sentences(spark):
    long_one, short = "Alpha beta gamma delta epsilon zeta.", "Oh no."
    rows = [(1, f"{short} {long_one} Other words stand here now."), (2, f"Something else entirely was said. {short} {long_one.upper()}"), (3, short)]
    got = {r.doc_id: r for r in remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert got[2].text == "Something else entirely was said."


def units_by_force(text, min_words=5):
    """(kind, words, start, end) of the lines and sentences of a text, in bytes."""
    out, at = [], 0
    for line in re.findall(rb"[^\n]*\n|[^\n]+", text.encode()):
        pieces, rest = [], b""
        for piece in re.findall(rb".*?[.!?](?=[ \t-\r]|$)|.+$", line, re.S):
            rest += piece
            if re.search(rb"[A-Za-z0-9\x80-\xff]", piece):
                pieces.append(rest)
                rest = b""
        words = [tuple(re.findall(rb"[a-z0-9\x80-\xff]+", p.lower())) for p in pieces]
        if len(pieces) == 1:
            out.append(("line" if len(words[0]) < min_words else "any", words[0], at, at + len(line)))
        elif not pieces and line.split():
            out.append(("bare", tuple(line.split()), at, at + len(line)))
        else:
            p = at
            for i, (piece, w) in enumerate(zip(pieces, words, strict=True)):
                end = at + len(line.rstrip(b" \t\n\v\f\r")) if i == len(pieces) - 1 else p + len(piece)
                out.append(("sentence" if len(w) < min_words else "any", w, p, end))
                p = end
        at += len(line)
    return out


def lines_by_force(rows):
    """(removed spans, text) of each (doc_id, text); no two rows are equal."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw, kept, at, gone = (t or "").encode(), b"", 0, []
        for kind, words, start, end in units_by_force(t or ""):
            if (kind, words) in seen:
                gone.append((start, end, seen[kind, words]))
                kept, at = kept + raw[at:start], end
            else:
                seen[kind, words] = i
        out[i] = (gone, None if t is None else (kept + raw[at:]).decode())
    return out


SHORT_LINES = [
    (1, "All rights reserved.\nFirst text of its own here.\n---\nYes. The very same sentence stands in two texts."),
    (2, "Second text of its own here.\n  all RIGHTS reserved\nNo. The very same sentence stands in two texts.\nmore"),
    (3, "All rights reserved. And some more of it.\n---\n...\n\nWait . . .\nMore!\nOh. Oh. Mine alone . .\nlast"),
    (4, "Oh. Mine alone. Unlike all others, this one. \n \nWAIT\n...\r\nend"),
    (None, "More\n***\nnaïve café\n日本"),
    (5, "NAÏVE café.\nnaïve café.\n日本!\n***"),
]


def test_line_dedup_of_short_lines_and_sentences(spark):
    got = {r.doc_id: r for r in remove_repeated_units(spark.createDataFrame(SHORT_LINES, "doc_id long, text string")).collect()}
    assert got[2].text == "Second text of its own here.\nNo.\n"
    assert got[3].text.startswith("All rights reserved. And some more of it.\n...\n")
    expected = lines_by_force(SHORT_LINES)
    assert {i: ([(s["start"], s["end"], s["kept_in"]) for s in r.removed], r.text) for i, r in got.items()} == expected


@pytest.mark.parametrize("heavy", [1, 4, 10_000])
def test_line_dedup_of_heavy_lines(spark, heavy):
    r = random.Random(4)
    rows = [(i, "\n".join(["This one line is everywhere.", *[f"Line {r.randint(0, 60)} of some of them." for _ in range(3)], f"Own {i}."])) for i in range(120)]
    got = remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), heavy=heavy)
    expected = lines_by_force(rows)
    assert {x.doc_id: ([(s["start"], s["end"], s["kept_in"]) for s in x.removed], x.text) for x in got.collect()} == expected


def test_decontamination_against_brute_force(spark):
    items = [(0, " ".join(cases.words(60, 2)) + "."), (1, " ".join(cases.words(30, 999))), (2, None), (3, ""), (4, "one two"), (5, " ".join(cases.words(120, 1)).upper()), (5, " ".join(cases.words(120, 1)))]
    docs = cases.documents(spark)
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def toks(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def bag(w, k):
        out = {}
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            out[s] = out.get(s, 0) + 1
        return out

    expected = {}
    for d, t in enumerate(cases.texts()):
        for item, text in items:
            w, m = toks(t), toks(text)
            k = min(5, len(m))
            if not m or len(w) < k:
                continue
            goal = bag(m, k)
            for s in range(max(1, len(w) - len(m) + 1)):
                part = bag(w[s : s + len(m)], k)
                both = sum(min(n, goal.get(x, 0)) for x, n in part.items())
                either = sum(part.values()) + sum(goal.values()) - both
                if both * 100 >= either * 75:
                    expected[d, item] = max(expected.get((d, item), 0), both / either)
    assert {k: v for k, v in got.items() if k[0] is not None} == pytest.approx(expected)
    assert contaminated(cases.empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_items_without_an_id_are_found(spark):
    one, two = " ".join(cases.words(40, 61)), " ".join(cases.words(40, 62))
    docs = spark.createDataFrame([(1, one), (2, f"before it {two} after it"), (3, "something else"), (4, f"{one} {two}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, one), (None, two), (7, one), (7, one)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()), key=str)
    assert got == sorted([(1, None), (1, 7), (2, None), (4, None), (4, None), (4, 7)], key=str)


def test_decontamination_in_parts_finds_the_same(spark, monkeypatch):
    from aeromart.llm import decontaminate

    items = spark.createDataFrame([(k, " ".join(cases.words(60, 2))) for k in range(3)], "item_id long, text string")
    whole = set(contaminated(cases.documents(spark), items).collect())
    monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", 40)
    assert set(contaminated(cases.documents(spark), items).collect()) == whole and whole


def test_nearest_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16))
    v[300:700] = v[300]  # one vector that many share
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [1.0, None] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for row in nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert sorted(got) == list(range(0, 1500, 20))
    single = v.astype(np.float32).astype(float)
    hits = 0
    for q, found in got.items():
        score = (single * single[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert [found[k][1] for k in sorted(found)] == sorted((x[1] for x in found.values()), reverse=True)
        hits += len({x[0] for x in found.values()} & set(order))
        if 300 <= q < 700:  # equal scores: smaller ids first
            assert [found[k][0] for k in range(1, 21)] == order
    assert hits >= 0.9 * 20 * len(got)
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours_of_repeated_query_rows(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8))
    other, hot = r.normal(size=8), r.normal(size=8)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist())] * 2 + [(20, other.tolist())] + [(40, hot.tolist())] * 150
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for row in nearest_neighbours(table, F.col("vec_id") % 20 == 0, share=1.0).collect():
        got.setdefault((row.query_id, row.query_hash), {})[row["rank"]] = row.vec_id
    asked = {(i, tuple(x)) for i, x in rows if i % 20 == 0}
    assert len(got) == len(asked) == 17 and all(sorted(x) == list(range(1, 21)) for x in got.values())

    def best(q, x):
        order = sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)
        return [i for _, i in order[:20]]

    assert sorted((q, [f[k] for k in sorted(f)]) for (q, _), f in got.items()) == sorted((q, best(q, np.array(x))) for q, x in asked)


def test_best_of_a_shard_against_brute_force():
    r = np.random.default_rng(8)
    rows, queries = r.normal(size=(400, 6)), r.normal(size=(30, 6))
    rows[100:250] = rows[100]  # many equal scores
    ids, own, c2 = r.permutation(400), r.integers(0, 400, 30), r.integers(0, 7, 400)
    listed = r.random((30, 7)) < 0.4
    listed[3] = False
    q, row, score = best_of(queries, own, listed, rows, ids, c2, 9)
    for i in range(30):
        open_rows = [j for j in range(400) if listed[i, c2[j]] and ids[j] != own[i]]
        expected = sorted(open_rows, key=lambda j: (-(rows[j] * queries[i]).sum(), ids[j]))[:9]
        assert row[q == i].tolist() == expected and (score[q == i] == (rows[expected] * queries[i]).sum(axis=1)).all()


def test_needed_share_is_the_least_that_gives_the_recall():
    r = np.random.default_rng(3)
    taken = np.repeat(r.normal(size=(8, 10)), 30, axis=0) + 0.2 * r.normal(size=(240, 10))
    model = (kmeans(taken[:, :5], 6), kmeans(taken[:, 5:], 6))
    c1, c2 = closest(taken[:, :5], model[0]), closest(taken[:, 5:], model[1])
    sizes = np.zeros((len(model[0]), len(model[1])), int)
    np.add.at(sizes, (c1, c2), 1)

    def recall(wanted):
        held = 0
        for i, v in enumerate(taken):
            score = taken @ v
            score[i] = -np.inf
            cells = set(traverse(model[0] @ v[:5], model[1] @ v[5:], sizes, wanted))
            held += sum((c1[j], c2[j]) in cells for j in np.argsort(-score, kind="stable")[:5])
        return held / 5 / len(taken)

    share = needed_share(taken, model, 5, 0.9)
    assert share < 0.5 and recall(share * 240) >= 0.9 > recall(share * 240 - sizes.max() - 1)
    assert needed_share(taken[:1], model, 5, 0.9) == 1.0


def test_cells_come_in_order_of_summed_closeness():
    r = np.random.default_rng(2)
    left, right = r.normal(size=6), r.normal(size=5)
    cells = traverse(left, right, np.ones((6, 5), int), 30)
    sums = [left[i] + right[j] for i, j in cells]
    assert len(cells) == 30 and sums == sorted(sums, reverse=True)


def test_suffix_dedup_of_texts_in_pieces(spark, monkeypatch):
    from aeromart.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "PIECE", 200)
    monkeypatch.setattr(suffixdedup, "CROWD", 2)
    shared = " ".join(cases.words(150, 3))
    texts = [shared + " tail one", "x" * 700, "head " + shared, "y" * 120 + "x" * 400, shared[300:700] + "end", shared, "x" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_spans(docs).collect()}
    assert got == spans_by_force(texts)
