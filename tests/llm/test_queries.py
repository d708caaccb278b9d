"""Registered document queries at the smallest scale, and the pipeline."""

import pytest

import corpus_pipeline
from chromafield.llm import queries, toxicity
from chromafield.session import scratch_path
from tests.check import compare, connect
from pyspark.sql import functions as F
from tests.llm.test_operators import EDGES, PROSE, linked, lower, mixed_by_hand, table, whole_coder


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLES:
        assert compare(df, connect(sf_dir), queries.ORACLES[name])[0] is None
    else:
        assert df.count() == queries.documents(spark, sf_dir).count()


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_pipeline(spark, sf_dir):
    """Each stage on its own input, by hand."""
    docs = queries.documents(spark, sf_dir)
    columns, rows = docs.columns, {}
    model = queries.toxicity_model(spark, docs, sf_dir)
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    rows["raw"] = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "byte_bpe" or docs.columns == columns
        rows[name] = [tuple(r) for r in docs.select(columns).collect()] if name != "byte_bpe" else docs.collect()

    assert sorted(r[0] for r in rows["toxicity"]) == sorted(clean)
    last = {}
    for i, text, *_ in rows["toxicity"]:
        last[lower(text)] = max(i, last.get(lower(text), i))
    assert sorted(r[0] for r in rows["exact_dedup"]) == sorted(last.values())
    root = linked([r[:2] for r in rows["exact_dedup"]], 5, 80)
    assert sorted(r[0] for r in rows["minhash_near_dedup"]) == sorted(i for i in root if root[i] == i)
    taken = [i for i, _ in mixed_by_hand(rows["minhash_near_dedup"], queries.MIXTURE)]
    assert sorted(r[0] for r in rows["mixing"]) == sorted(taken)
    texts, coder = {r[0]: r[1] for r in rows["raw"]}, whole_coder()
    assert sorted(r.doc_id for r in rows["byte_bpe"]) == sorted(taken)
    for r in rows["byte_bpe"]:
        assert r.token_ids == coder.encode_ordinary(texts[r.doc_id] or "") and r.round_trip
        assert r.n_tokens == len(r.token_ids)
    assert 0 < len(taken) < len(rows["raw"])


def test_pipeline_keeps_clashing_columns(spark, sf_dir):
    """Columns named like operators' results, nulls, empty and repeated rows pass every stage."""
    names = ["score", "predicted", "domain", "tokens", "epoch", "kept", "token_ids", "n_tokens", "round_trip", "decoded"]
    rows = EDGES + [(100 + i, f"{PROSE} {i} " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(30)]
    docs = table(spark, rows, more=False)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            for i, c in enumerate(names):
                assert out.where(f"not ({c} <=> concat('{i}:', doc_id))").count() == 0
        docs = out
    assert docs.count() > 0 and docs.where("not round_trip or n_tokens <> size(token_ids)").count() == 0
    assert docs.where("not (domain <=> concat('2:', doc_id)) or not (kept <=> concat('5:', doc_id))").count() == 0
    assert len(set(docs.columns)) == len(docs.columns) and "text" not in docs.columns


def test_pipeline_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, [], more=False)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out if name != "byte_bpe" else docs


def test_pipeline_runs_as_a_query(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.where("not round_trip").count() == 0 and rows.count() > 0
