import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import queries
from tests.conftest import SF


def test_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        docs = out[name] = spark.read.parquet(str(top / name))
    return out


def test_stages_keep_the_columns(stages):
    want = [(f.name, f.dataType) for f in stages["documents"].schema]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert [(f.name, f.dataType) for f in stages[name].schema] == want


def test_decisions_take_effect(spark, stages):
    ids = {k: [r.doc_id for r in d.select("doc_id").collect()] for k, d in stages.items()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids["quality"])
    assert sum(label[i] == 1 and i not in kept for i in label) <= 0.03 * len(label) and sum(label[i] == 0 and i in kept for i in label) <= 0.05 * len(label)
    assert sorted(ids["line_dedup"]) == sorted(ids["quality"]) and set(ids["near_duplicates"]) < set(ids["line_dedup"])
    from tests.llm import brute

    of = brute.near_duplicates([(r.doc_id, r.text) for r in stages["line_dedup"].collect()])
    assert set(ids["near_duplicates"]) == {i for i, (_, c) in of.items() if c == i}
    assert set(ids["mixing"]) <= set(ids["near_duplicates"]) and max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 3
    assert sorted(ids["packing"]) == sorted(ids["mixing"])


def test_columns_that_clash(spark, stages):
    """Further columns, named like the operators' own, pass through every stage but the last."""
    own = ["size", "copies", "_mix_copies", "id", "tag", "lines", "gone", "_quire_0", "nth", "u", "d", "m"]
    d = stages["documents"].where("doc_id < 60").withColumns({c: F.lit(f"own {c}") for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in own), name


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(stages["packing"]).isEmpty() and got.count() == stages["packing"].count()


def test_stages_of_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "", "en", "s", 0), (3, "x y\n" * 50, None, "s", 200)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        got = stage(spark, odd, SF)
        ids = sorted((r.doc_id for r in got.select("doc_id").collect()), key=str)
        if name == "line_dedup":
            assert ids == [1, 1, 2, 3, None] and {r.doc_id: r.text for r in got.collect()} == {1: None, 2: "", None: "a b c", 3: "x y\n"}
        elif name == "near_duplicates":
            assert ids == [1, 1, 2, 3, None]  # nothing is linked
        elif name == "mixing":
            assert 2 not in ids and 1 not in ids and {3, None} >= set(ids)  # without words, in no mix
        elif name == "packing":
            assert ids == [1, 1, 2, 3, None] and sum(r.n_tokens for r in got.collect()) == 103
        else:
            assert ids.count(1) in (0, 2) and got.columns == odd.columns  # null texts go or stay alike
