"""The registered queries and the pipeline over whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blendwise.llm import packing, pii, queries, toxicity
from tests.compare import database, differences
from tests.llm.test_llm import brute_components, brute_hits

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.ORACLES[name]) == ""


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_jaccard_query_equals_brute_force(spark):
    docs = sorted(texts(spark).items())
    expected = brute_components([t for _, t in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_jaccard_join(spark, FOLDER).collect()}
    assert got == {docs[i][0]: (n, docs[root][0]) for i, (n, root) in expected.items()}


@pytest.mark.parametrize("name", ["op5_url_filter", "op6_language_id", "op7_shard_ring", "op9_quality", "op10_personal_data"])
def test_one_row_for_each_row(spark, name):
    source = "pages" if name == "op5_url_filter" else "documents"
    found = queries.QUERIES[name](spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
    if "held_out" in found.columns:
        assert found.where("score < 0 OR score > 1").count() == 0


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = texts(spark)
    model = queries.toxicity_model(spark, FOLDER, docs)
    if isinstance(model, toxicity.Network):
        ids = list(kept)
        scores = model.probability(toxicity.Scorer(model).logits([kept[i] for i in ids]))
        kept = {i: kept[i] for i, s in zip(ids, scores) if not s >= 0.5}
    order = sorted(kept)
    roots = brute_components([kept[i] for i in order])
    kept = {order[i]: kept[order[i]] for i, (n, root) in roots.items() if i == root}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = {i: brute_hits(t, bench) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not hits[i][1] or 20 * hits[i][1] < hits[i][0]}
    encoder = packing.Encoder(packing.tokenizer_path())
    tokens = {i: len(encoder.encode([pii.redact(t, pii.personal_data(t)[1])])[0]) // 2 for i, t in kept.items()}
    found = corpus_pipeline.run(spark, FOLDER)
    got = {r.doc_id: (r.n, r.total) for r in found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()}
    assert got == {i: (n, n) for i, n in tokens.items()}
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    ends = found.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("e"), F.sum("length").alias("n"))
    assert ends.where("e <> n OR n > 4096").count() == 0
    assert np.isfinite(ends.count())
