"""Files read and written."""

import json
import os

import pytest
from pyspark.errors import PySparkException

from blendwise.operators.packing import pack_chunks
from blendwise.operators.tokens import tokenize
from blendwise.session import shared_folder
from blendwise.sources import configs, corpus, tables


def test_yaml_values(spark, tmp_path):
    (tmp_path / "n7.yaml").write_text(
        "train:\n  train_a: 0\n  train_b: 1\n  train_c: 0.0002\n  train_d: 1e-05\nvalid:\n  valid_a: 1.0\nmodel_name: m\nmax_step: 5"
    )
    (tmp_path / "notes.txt").write_text("no config")
    found = configs.read_mixture_configs(spark, str(tmp_path)).collect()
    assert {r["index"] for r in found} == {7} and found[0].params == {"model_name": "m", "max_step": "5"}
    assert {r.domain: r.value for r in found} == {
        "train_a": "0", "train_b": "1", "train_c": "0.0002", "train_d": "1e-05", "valid_a": "1.0"
    }


def test_other_config_names_are_an_error(spark, tmp_path):
    (tmp_path / "best.yaml").write_text("train:\n  train_a: 1")
    with pytest.raises(PySparkException, match="config name"):
        configs.read_mixture_configs(spark, str(tmp_path)).collect()


def test_configs_are_single_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 0.25), (1, "a", 0.75), (2, "a", 1.0)], "index long, domain string, weight double")
    configs.write_mixture_configs(df, str(tmp_path), {"seed": 42})
    files = sorted(f for f in os.listdir(tmp_path) if not f.startswith("."))
    assert files == ["n1.yaml", "n2.yaml"]
    assert (tmp_path / "n1.yaml").read_text().strip() == (
        "train:\n  train_a: 0.75\n  train_b: 0.25\nvalid:\n  valid_a: 1.0\n  valid_b: 1.0\nseed: 42"
    )


def test_config_sink_is_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(40)], "index long, domain string, weight double")
    wrong = tmp_path / "n7.yaml"
    wrong.write_text("other")
    with pytest.raises(Exception, match="exists already"):
        configs.write_mixture_configs(df, str(tmp_path))
    assert os.listdir(tmp_path) == ["n7.yaml"] and wrong.read_text() == "other"
    wrong.unlink()
    for _ in range(2):  # the second time it meets its own files, like a task that runs again
        configs.write_mixture_configs(df, f"file:{tmp_path}")
        assert sorted(os.listdir(tmp_path)) == sorted(f"n{i}.yaml" for i in range(40))
    assert configs.read_mixture_configs(spark, str(tmp_path)).select("index").distinct().count() == 40


def write_corpus(root, files):
    os.makedirs(f"{root}/train")
    for name, texts in files.items():
        with open(f"{root}/train/{name}", "w", encoding="utf-8") as out:
            out.writelines(json.dumps({"text": t, "meta": 1}) + "\n" for t in texts)


def test_corpus_takes_the_first_files(spark, tmp_path):
    write_corpus(tmp_path, {f"d{i}-0.jsonl": ["x"] for i in range(5)})
    found = corpus.read_corpus(spark, str(tmp_path), "train", 0.5)
    assert sorted(r.domain for r in found.collect()) == ["d0", "d1"]


def test_corpus_order_survives_splits(spark, tmp_path):
    texts = [f"w{i}" for i in range(2000)]
    write_corpus(tmp_path, {"news-0.jsonl": texts})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        docs = tokenize(corpus.read_corpus(spark, str(tmp_path), numbered=True), eos=False)
        assert docs.rdd.getNumPartitions() > 1
        chunks = pack_chunks(docs, 100, order=("block_start", "row_id"), bucket=corpus.block_bucket())
        found = [t for r in chunks.orderBy("chunk_no").collect() for t in r.tokens]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == texts


def test_chunks_are_pruned_by_domain(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 0, [1]), ("train", "b", 0, [2])], "split string, domain string, shard int, tokens array<int>")
    tables.write_chunks(df, str(tmp_path / "c"))
    found = tables.read_chunks(spark, str(tmp_path / "c"), ["b"])
    assert [r.tokens for r in found.collect()] == [[2]]
    assert tables.read_chunks(spark, str(tmp_path / "c"), df.where("shard = 0").select("domain").limit(2)).count() == 2


def test_wide_csv_keeps_order_and_slashes(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5), (1, None)], "index long, `metric/a_val_loss` double")
    tables.write_wide_csv(df, str(tmp_path / "w"))
    found = tables.read_wide_csv(spark, str(tmp_path / "w"))
    assert found.columns == ["index", "metric/a_val_loss"]
    assert sorted(map(tuple, found.collect())) == [(1, None), (2, 0.5)]


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_number_like_domains_stay_as_written(spark, tmp_path):
    from blendwise.sources import tables

    names = ["007", "12", "1e3", "true", "2020-01-01"]
    rows = [("train", d, i, [i]) for i, d in enumerate(names)]
    chunks = spark.createDataFrame(rows, "split string, domain string, chunk_no int, tokens array<int>")
    tables.write_chunks(chunks, str(tmp_path / "c"))
    found = tables.read_chunks(spark, str(tmp_path / "c"))
    assert sorted(r.domain for r in found.collect()) == sorted(names)
    assert [r.chunk_no for r in tables.read_chunks(spark, str(tmp_path / "c"), ["007"]).collect()] == [0]
