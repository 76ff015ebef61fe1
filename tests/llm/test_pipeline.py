from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as c
from textloom.llm import near_duplicates, secrets, toxicity
from textloom.llm.tokens import encoder


@pytest.fixture(scope="module")
def stages(spark, sf, documents, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = documents, [documents]
    for name, stage in c.STAGES:
        stage(spark, docs, sf).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs)
    return out


def test_stages(stages, spark, sf):
    given, clean, single, safe, mixed, packed = stages
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(set(x.columns) == set(given.columns) for x in (clean, single, safe, mixed))
    model = toxicity.learn(given, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in toxicity.score(given, model).where("predicted = 0").collect())
    kept = near_duplicates.near_duplicates(clean).where("kept")
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in kept.collect())
    before = {r.doc_id: r.text for r in single.collect()}
    for r in safe.collect():
        assert r.text == secrets.redacted(before[r.doc_id]) and r.n_chars == len(r.text)
    encode = encoder()
    pieces: dict = {}
    for r in packed.collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    want: dict = {}
    for r in mixed.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(np.append(encode(r.text), 1))
    assert pieces == want


def test_run(spark, sf, stages):
    assert c.run(spark, sf).count() == stages[-1].count()
    assert c.ORACLE_SQL is None


def test_odd_rows(spark, crowded, empty, tmp_path):
    spark.createDataFrame([(5, 1, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for i, start in enumerate((crowded, empty)):
        docs = start
        for name, stage in c.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{i}{name}"))
            before, docs = docs, spark.read.parquet(str(tmp_path / f"{i}{name}"))
            if name != "packing":
                assert docs.columns == before.columns
