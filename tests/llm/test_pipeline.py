"""The pipeline on small tables, stage by stage."""

import corpus_pipeline
from aeromart.llm.common import stored
from aeromart.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_hard_documents(spark):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() <= before
        if name != "packing":
            assert docs.columns == COLUMNS
    left = {r.doc_id for r in docs.collect()}
    assert {0, 24, 25, 31} <= left and not {1, 2, 3, 27, 28} & left


def test_stages_on_an_empty_table(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run_keeps_clean_documents_once(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in out}) == len(out) > 0


def test_decisions_are_on_rows_not_ids(spark):
    a, b, c = (cases.words(60, 300 + k) for k in range(3))
    near = [*b[:-1], "other"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(5, a), (5, b), (3, near), (9, a), (None, near), (None, c), (None, c), (7, [item]), (7, cases.words(60, 400)), (None, [item, "x"]), (8, cases.words(60, 401)), (8, cases.words(60, 401))]
    docs = spark.createDataFrame([(i, " ".join(t), "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)], cases.EMPTY).repartition(3)
    left = corpus_pipeline.one_of_each_group(spark, docs, SF)
    expected = [(5, a), (3, near), (None, c), (7, rows[8][1]), (8, rows[10][1])]
    unique = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert [x for x in unique if item not in x[1]] == sorted(((i, " ".join(t)) for i, t in expected), key=str)
    left = corpus_pipeline.without_benchmark(spark, docs, SF).collect()
    assert sorted(r.source for r in left) == sorted(f"s{n}" for n, (_, t) in enumerate(rows) if item not in t)


def test_decontamination_writes_no_copy_of_the_texts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, *a: kept.append((df.columns, a)) or stored(df, *a))
    docs = cases.documents(spark)
    corpus_pipeline.without_benchmark(spark, docs, SF).count()
    assert not kept
    corpus_pipeline.one_of_each_group(spark, docs, SF).count()
    assert [a for columns, a in kept if "text" in columns] == [("pipeline-rows", "zstd")]


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]
