import os

import corpus_pipeline as cp
from quarrylog.llm import queries

from .conftest import corpus, make


def test_stages_in_order(spark):
    docs = make(spark, corpus() + [(500, "mail me at a.b@c.org about the thing of and the rest"), (501, "漢字 仮名 交じり 文"), (None, "no id but text of the usual kind and more")])
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sizes == sorted(sizes, reverse=True) and None in texts and 0 not in texts and 501 not in texts
    assert "a.b@c.org" not in texts[500] and all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = cp.STAGES[-1][1](spark, docs, "")
    assert pieces.select("doc_id").distinct().count() == len(texts)


def test_empty_table(spark):
    docs = make(spark, [])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_and_queries_are_registered(spark):
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "private", "packing"]
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    folder = "/root/testdata/sf0.001"
    if os.path.isdir(folder):
        assert cp.run(spark, folder).count() > 0


def test_stages_bound_what_goes_to_python_at_a_time(spark):
    before = spark.conf.get(cp.BATCH_SETTING)
    docs = make(spark, corpus())
    try:
        for name, stage in cp.STAGES:
            for given, rows in ((10_000, cp.BATCH_ROWS), (0, cp.BATCH_ROWS), (7, 7)):
                spark.conf.set(cp.BATCH_SETTING, given)
                if name not in ("lines", "near_duplicates"):
                    stage(spark, docs, "")
                    assert int(spark.conf.get(cp.BATCH_SETTING)) == rows, name
    finally:
        spark.conf.set(cp.BATCH_SETTING, before)
