import random

import pytest

from ledgerline.llm import registry
from ledgerline.llm.components import components


def test_ten_operators_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.queries()) == list(range(1, 11))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(900, 900), (5, 3), (3, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unfinished_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("ledgerline.llm.components.ROUNDS", 2)
    with pytest.raises(RuntimeError, match="2 rounds"):
        components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"))


def test_pipeline_stages_run(spark, docs, words, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(words(60, i))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, "leak " + rows[0][1]), (102, None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {*range(1, 40), 102}
