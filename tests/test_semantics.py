"""Rules of the method on small tables."""

import math
import random
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blendwise.functions import names, numbers
from blendwise.operators import history, monitor, packing, regression, runs, sampling, stats, synthesis, tokens, weights


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- weights ---------------------------------------------------------------------------------------------------


def test_exact_rounding_is_that_of_python(spark):
    chance = random.Random(1)
    values = [0.123455, 6.5e-05, 2.5e-05, 0.000145, 0.5, 0.0, 1.0] + [chance.random() for _ in range(300)]
    values += [k / 1e6 for k in range(5, 3000, 10)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = df.select("x", numbers.round_exact(F.col("x"), 5).alias("y"), names.format_weight(F.col("x")).alias("t"))
    for r in found.collect():
        assert r.y == round(r.x, 5)
        assert r.t == f"{r.x:.5f}".rstrip("0").rstrip(".")


def test_temperature_uses_its_argument(spark):
    df = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.1)], "index long, domain string, weight double")
    found = dict(rows(weights.temper(df, 0.25), "domain", "weight"))
    assert found["a"] == pytest.approx(0.9**0.25 / (0.9**0.25 + 0.1**0.25))
    assert dict(rows(weights.temper(df, 1.0), "domain", "weight")) == {"a": 0.9, "b": 0.1}


def test_usage_bound_stops_at_one(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.01)], "domain string, prior double")
    assert dict(rows(weights.usage_bounds(df), "domain", "bound")) == {"a": 1.0, "b": pytest.approx(0.15)}


def test_clean_weights_keeps_numbers_and_reports_the_rest(spark):
    raw = spark.createDataFrame(
        [(1, "train_a", "0"), (1, "train_b", "1e-05"), (1, "train_c", "0.1234567"), (1, "train_d", "x"), (1, "valid_a", "1")],
        "index long, domain string, value string",
    )
    assert dict(rows(weights.clean_weights(raw), "domain", "weight")) == {"train_a": 0, "train_b": 1e-05, "train_c": 0.12346}
    assert rows(weights.rejected_weights(raw), "domain") == [("train_d",)]


def test_wide_and_long_keep_missing_cells(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "index long, domain string, weight double")
    assert rows(weights.to_long(weights.to_wide(df)), "index", "domain", "weight") == rows(df, "index", "domain", "weight")


# --- synthesis -------------------------------------------------------------------------------------------------


def samples(spark, *vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "sample_id long, weights array<double>")


def domains(spark, **values):
    return spark.createDataFrame(list(values.items()), "domain string, bound double")


def test_bounds_are_inclusive_and_reject_whole_rows(spark):
    found = synthesis.reject_out_of_bounds(samples(spark, (0.6, 0.4), (0.61, 0.39)), domains(spark, a=0.6, b=1.0))
    assert rows(found, "sample_id") == [(0,)]


def test_quantize_cuts_and_keeps_uneven_sums(spark):
    found = synthesis.quantize(samples(spark, (0.00019, 0.5, 0.49981), (0.3333, 0.3333, 0.3334)), 0.001).collect()
    found = {r.sample_id: r for r in found}
    assert found[0].units == [0, 500, 500]
    assert found[1].units == [333, 333, 333] and sum(found[1].weights) == pytest.approx(0.999)


def test_quantize_rounds_half_to_even(spark):
    found = synthesis.quantize(samples(spark, (0.25, 0.75)), 0.1).first()
    assert found.units == [2, 8]


def test_dedup_on_grid(spark):
    vectors = [(0.5, 0.5), (0.5, 0.5), (0.4998, 0.5002)]
    assert rows(synthesis.dedup_mixtures(synthesis.quantize(samples(spark, *vectors))), "sample_id") == [(0,), (2,)]


def brute_close(vectors, threshold):
    order = sorted(range(len(vectors)), key=lambda i: tuple(reversed(vectors[i])))
    kept = [order[0]]
    for i in order[1:]:
        if sum(abs(a - b) for a, b in zip(vectors[i], vectors[kept[-1]])) > threshold:
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("threshold,bucket_size", [(1e-5, 1024), (0.02, 7), (0.1, 30)])
def test_dedup_close_is_the_sequential_rule(spark, threshold, bucket_size):
    chance = random.Random(3)
    vectors = [(0.2, 0.8), (0.200004, 0.799996), (0.200008, 0.799992), (0.200012, 0.799988)]
    vectors += [(round(x, 3), round(1 - x, 3)) for x in {chance.random() for _ in range(120)}]
    vectors = list(dict.fromkeys(vectors))
    found = synthesis.dedup_close(samples(spark, *vectors).repartition(3), threshold, bucket_size)
    assert [r[0] for r in rows(found, "sample_id")] == brute_close(vectors, threshold)


def test_dedup_close_follows_one_chain_across_many_buckets(spark):
    steps = [round(0.1 + 0.003 * i, 4) for i in range(60)] + [0.9, 0.9001, 0.9002, 0.9003, 0.9004, 0.99]
    vectors = [(x, round(1 - x, 4)) for x in steps]
    found = synthesis.dedup_close(samples(spark, *vectors), 0.011, 2)
    assert [r[0] for r in rows(found, "sample_id")] == brute_close(vectors, 0.011)
    assert synthesis.dedup_close(samples(spark, *vectors).limit(0), 0.011).count() == 0


def test_too_few_mixtures_are_an_error(spark):
    with pytest.raises(ValueError, match="3 mixtures wanted, found 2"):
        synthesis.choose_configs(samples(spark, (1,), (2,)), 3).select("sample_id").collect()
    with pytest.raises(ValueError, match="5 mixtures wanted, found 0"):
        synthesis.choose_configs(samples(spark, (1,)).limit(0), 5)


def prior(spark):
    return spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.08), ("d", 0.02)], "domain string, prior double")


def test_dirichlet_mean_and_variance(spark):
    """Within four standard errors; each weight follows a Beta(share, 1 - share) distribution."""
    n = 20000
    found = synthesis.dirichlet_sample(prior(spark), n, 7)
    vectors = np.array([r.weights for r in found.select("weights").collect()])
    shares = np.array([0.6, 0.3, 0.08, 0.02])
    raw = [np.prod([(shares + i) / (1 + i) for i in range(k)], axis=0) for k in range(5)]
    variance = raw[2] - raw[1] ** 2
    fourth = raw[4] - 4 * raw[3] * raw[1] + 6 * raw[2] * raw[1] ** 2 - 3 * raw[1] ** 4
    assert np.allclose(vectors.sum(axis=1), 1, atol=1e-9)
    assert np.all(np.abs(vectors.mean(axis=0) - shares) < 4 * np.sqrt(variance / n))
    assert np.all(np.abs(vectors.var(axis=0) - variance) < 4 * np.sqrt((fourth - variance**2) / n))


def test_dirichlet_does_not_depend_on_partitions(spark):
    whole = rows(synthesis.dirichlet_sample(prior(spark), 50), "sample_id", "weights")
    parts = rows(synthesis.dirichlet_sample(prior(spark), 30), "sample_id", "weights") + rows(
        synthesis.dirichlet_sample(prior(spark), 20, start=30), "sample_id", "weights"
    )
    assert whole == sorted(parts)


def test_synthesis_stays_on_grid_and_within_bounds(spark):
    found = synthesis.synthesize_mixtures(prior(spark), 20, max_usage=2)
    by_index = {}
    for r in found.collect():
        by_index.setdefault(r["index"], {})[r.domain] = r.weight
        assert abs(r.weight / 2e-4 - round(r.weight / 2e-4)) < 1e-9
    assert sorted(by_index) == list(range(1, 21))
    for mixture in by_index.values():
        # Cutting and rounding come after the bounds, so these may be left by a few grid steps.
        assert mixture["d"] <= 0.04 + 1e-3 and mixture["c"] <= 0.16 + 1e-3
        assert sum(mixture.values()) == pytest.approx(1, abs=1e-3)


def test_synthesis_without_bounds(spark):
    assert synthesis.synthesize_mixtures(prior(spark), 5, enable_bound=False).count() == 20


def test_strength_grid_is_logarithmic():
    grid = synthesis.strength_grid()
    assert len(grid) == 15 and grid[0] == pytest.approx(0.1) and grid[-1] == pytest.approx(5.0)
    assert grid[7] == pytest.approx(math.sqrt(0.5))
    assert synthesis.strength_grid(1.0, 1.0) == [1.0]


# --- names and tokens ------------------------------------------------------------------------------------------


def test_dash_keeps_prefixes_apart(spark):
    files = spark.createDataFrame([("news-0.bin",), ("news_cc-0.bin",), ("a-b-1.bin",)], "name string")
    keys = spark.createDataFrame([("news",), ("a",), ("a-b",)], "key string")
    assert rows(tokens.match_domain(files, keys), "key", "name") == [
        ("a", "a-b-1.bin"), ("a-b", "a-b-1.bin"), ("news", "news-0.bin")
    ]


def test_domain_and_shard_of_names(spark):
    paths = ["x/train/news-3.jsonl.gz", "train_demo_news-3_7_0000000002.bin", "readme.txt"]
    df = tokens.with_domain(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.path: (r.domain, r.shard) for r in df.collect()} == {
        paths[0]: ("news", 3), paths[1]: ("train_demo_news", 3), paths[2]: ("readme", None)
    }


def test_short_domain(spark):
    df = spark.createDataFrame([("train_demo_arxiv",), ("valid_demo_arxiv",), ("arxiv",)], "d string")
    assert rows(df.select(names.short_domain(F.col("d"), "demo").alias("s")), "s") == [("arxiv",)] * 3


@pytest.mark.parametrize(
    "options, wanted",
    [
        ({}, ["a", "b", "</s>"]),
        ({"bos": True}, ["<s>", "a", "b", "</s>"]),
        ({"max_length": 2}, ["a", "b"]),
        ({"eos": False}, ["a", "b"]),
        ({"bos": True, "max_length": 3}, ["<s>", "a", "b"]),
    ],
)
def test_end_mark_can_be_cut(spark, options, wanted):
    df = spark.createDataFrame([(" a\n\tb ",)], "text string")
    assert tokens.tokenize(df, **options).first().tokens == wanted


def test_empty_text_has_only_the_end_mark(spark):
    df = spark.createDataFrame([("",), (None,)], "text string")
    assert {r.n_tokens for r in tokens.count_tokens(df).collect()} == {1}
    assert all(r.tokens == ["</s>"] for r in tokens.tokenize(df).collect())


def test_ids_by_join(spark):
    docs = spark.createDataFrame(
        [(0, ["b", "a", "b"]), (1, []), (2, ["c", "a"]), (3, None)], "doc_id long, tokens array<string>"
    ).repartition(2)
    vocab = tokens.build_vocab(docs, 5)
    assert rows(vocab.where("n > 0"), "token", "id", "n") == [("a", 3, 2), ("b", 4, 2)]
    found = {r.doc_id: r.ids for r in tokens.encode_ids(docs, vocab).collect()}
    assert found == {0: [4, 3, 4], 1: [], 2: [0, 3], 3: None}


def test_ids_are_made_in_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(tokens, "TOKENS_AT_ONCE", 10)
    texts = [None if i % 7 == 0 else ["a", "b", "x"] * (i % 6) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "tokens"])
    sent = SimpleNamespace(value=pa.table({"token": ["a", "b"], "id": pa.array([3, 4], pa.int32())}))
    found = list(tokens._encoder(sent, ["doc_id"], "ids", 0)([batch, batch.slice(5, 20)]))
    assert all(b.num_rows == 1 or sum(len(x or ()) for x in b.column(1).to_pylist()) <= 10 for b in found)
    ids = [None if t is None else [{"a": 3, "b": 4}.get(w, 0) for w in t] for t in texts]
    assert [x for b in found for x in b.column(1).to_pylist()] == ids + ids[5:25]
    assert [x for b in found for x in b.column(0).to_pylist()] == [*range(40), *range(5, 25)]


# --- packing ---------------------------------------------------------------------------------------------------


def brute_chunks(docs, size):
    flat = [t for _, doc in sorted(docs) for t in doc]
    return [flat[i : i + size] for i in range(0, len(flat), size)]


@pytest.mark.parametrize("lengths", [[23], [3, 4, 3], [2, 2], [1, 9, 1, 1, 8, 5], [10, 10], [5, 0, 6]])
@pytest.mark.parametrize("bucket", [None, "id"])
def test_packing_equals_brute_force(spark, lengths, bucket):
    docs = [(i, [f"{i}.{j}" for j in range(n)]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame([("d", 0, i, t) for i, t in docs], "domain string, shard int, doc_id long, tokens array<string>")
    cut = None if bucket is None else F.floor(F.col("doc_id") / 2)
    wanted = brute_chunks(docs, 5)
    whole = packing.pack_chunks(df, 5, bucket=cut).orderBy("chunk_no").collect()
    assert [r.tokens for r in whole] == [c for c in wanted if len(c) == 5]
    padded = packing.pack_chunks(df, 5, keep_tail=True, pad="<s>", bucket=cut).orderBy("chunk_no").collect()
    assert [r.tokens for r in padded] == [c + ["<s>"] * (5 - len(c)) for c in wanted]


@pytest.mark.parametrize("held,bucket", [(1, 1), (1 << 20, 3), (40, 100)])
def test_packing_ids_of_many_files_equals_brute_force(spark, monkeypatch, held, bucket):
    monkeypatch.setattr(packing, "TOKENS_HELD", held)
    docs, files = [], {}
    for i in range(200):
        name, shard, n = ("a", None, "b")[i % 3], i % 2, (i * 7) % 23 if i % 11 else 0
        docs.append((name, shard, i, None if i % 17 == 0 else [1000 * i + j for j in range(n)]))
        files.setdefault((name, shard), []).append((i, docs[-1][3] or []))
    df = spark.createDataFrame(docs, "domain string, shard int, doc_id long, tokens array<int>").repartition(5)
    found = {}
    for r in packing.pack_chunks(df, 16, keep_tail=True, pad=-1, bucket=F.floor(F.col("doc_id") / bucket)).collect():
        found[r.domain, r.shard, r.chunk_no] = r.tokens
    wanted = {}
    for (name, shard), rows_ in files.items():
        for number, chunk in enumerate(brute_chunks(rows_, 16)):
            wanted[name, shard, number] = chunk + [-1] * (16 - len(chunk))
    assert found == wanted
    assert packing.pack_chunks(df.limit(0), 16, bucket=F.col("doc_id")).count() == 0


def test_tokens_are_shuffled_once(spark):
    df = spark.createDataFrame([("a", 0, 1, [1, 2, 3])], "domain string, shard int, doc_id long, tokens array<int>")
    found = packing.pack_chunks(df, 2, bucket=F.col("doc_id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "strategy=broadcast" in plan
    moved = {line.split("RepartitionByExpression")[1] for line in plan.splitlines() if "RepartitionByExpression" in line}
    assert len({m.split("#")[0] for m in moved}) == 1


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_ids_are_the_same_by_lookup_and_by_join(spark, limit):
    texts = [(i, t) for i, t in enumerate([["b", "a", "a"], [], None, ["c", None, "x"], ["<s>", "b"] * 50, ["y"]])]
    docs = spark.createDataFrame(texts, "doc_id long, tokens array<string>")
    vocab = tokens.build_vocab(docs.where("doc_id < 5"), 5)
    ids = {r.token: r.id for r in vocab.collect()}
    found = {r.doc_id: r.ids for r in tokens.encode_ids(docs, vocab, limit=limit).collect()}
    assert found == {i: None if t is None else [ids.get(w, 0) for w in t] for i, t in texts}
    assert tokens.encode_ids(docs, vocab, limit=limit).columns == ["doc_id", "ids"]


def test_chunks_never_mix_files(spark):
    df = spark.createDataFrame(
        [("d", s, s, [str(s)] * 7) for s in range(3)], "domain string, shard int, doc_id long, tokens array<string>"
    )
    for r in packing.pack_chunks(df, 5).collect():
        assert set(r.tokens) == {str(r.shard)}
    report = packing.packing_report(df.withColumn("n_tokens", F.size("tokens")), 5)
    assert rows(report, "shard", "n_chunks", "lost_tokens") == [(0, 1, 2), (1, 1, 2), (2, 1, 2)]


def test_blocks_drop_the_rest_and_shift_by_one(spark):
    df = spark.createDataFrame([(list(range(11)),), (list(range(2)),)], "tokens array<int>")
    pairs = packing.shift_targets(packing.slice_blocks(df, 4), 3)
    assert rows(pairs, "block_no", "input_ids", "targets") == [(0, [0, 1, 2], [1, 2, 3]), (1, [4, 5, 6], [5, 6, 7])]


# --- sampling --------------------------------------------------------------------------------------------------


def test_seven_files_over_three_workers(spark):
    files = spark.createDataFrame([("d", f"f{i}") for i in range(7)] + [("e", "g0"), ("e", "g1")], "domain string, path string")
    dealt = sampling.assign_workers(sampling.shuffle_shards(files), 3).collect()
    assert len(dealt) == 6 and {r.domain for r in dealt} == {"d"}
    assert sorted(r.worker for r in dealt) == [0, 0, 1, 1, 2, 2]


def test_sparse_domains_leave(spark):
    wanted = spark.createDataFrame([("d", 0.5), ("e", 0.3), ("f", 0.2), ("g", 0.1)], "domain string, weight double")
    files = spark.createDataFrame([("d",)] * 3 + [("e",)] * 2 + [("f",)] * 3, "domain string")
    found = dict(rows(sampling.drop_sparse_domains(wanted, files, 3), "domain", "weight"))
    assert found == {"d": pytest.approx(5 / 7), "f": pytest.approx(2 / 7)}
    grouped = wanted.withColumn("grp", F.when(F.col("domain").isin("d", "e"), "x").otherwise(F.col("domain")))
    assert rows(sampling.drop_sparse_domains(grouped, files, 3, "grp"), "domain", "weight") == [("f", 1.0)]


def blocks(spark, **counts):
    rows_ = [(d, i, f"{d}{i}") for d, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows_, "domain string, block_seq long, name string")


def test_draws_wrap_round_and_resume(spark):
    wanted = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "domain string, weight double")
    store = blocks(spark, a=5, b=50)
    whole = rows(sampling.mixture_sample(store, wanted, 400), "pos", "domain", "nth", "epoch", "name")
    assert [r[0] for r in whole] == list(range(400))
    seen = {}
    for pos, domain, nth, epoch, name in whole:
        assert nth == seen.get(domain, 0)
        size = {"a": 5, "b": 50}[domain]
        assert (epoch, name) == (nth // size, f"{domain}{nth % size}")
        seen[domain] = nth + 1
    assert abs(seen["a"] - 300) < 4 * math.sqrt(400 * 0.75 * 0.25)
    assert rows(sampling.mixture_sample(store, wanted, 150, start=250), "pos", "domain", "nth", "epoch", "name") == whole[250:]


def test_resume_beyond_one_bucket(spark):
    wanted = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "domain string, weight double")
    store = blocks(spark, a=3, b=4)
    whole = sampling.mixture_sample(store, wanted, 70000).where("pos >= 69990")
    rest = sampling.mixture_sample(store, wanted, 10, start=69990)
    assert rows(rest, "pos", "domain", "nth") == rows(whole, "pos", "domain", "nth")


def test_wanted_domain_without_blocks_is_an_error(spark):
    wanted = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "domain string, weight double")
    with pytest.raises(PySparkException, match="no blocks for domain b"):
        sampling.mixture_sample(blocks(spark, a=3), wanted, 20).collect()


def test_one_domain_per_micro_batch(spark):
    wanted = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "domain string, weight double")
    drawn = rows(sampling.mixture_sample(blocks(spark, a=3, b=3), wanted, 64, level=8), "pos", "domain")
    by_batch = {}
    for pos, domain in drawn:
        by_batch.setdefault(pos // 8, set()).add(domain)
    assert all(len(found) == 1 for found in by_batch.values()) and len(set.union(*by_batch.values())) == 2


def test_blocks_are_shuffled_within_buffers_only(spark):
    df = spark.createDataFrame([("d", c, b) for c in range(4) for b in range(6)], "domain string, chunk_pos long, block_no long")
    found = sampling.shuffle_blocks(df, n_chunks=2).collect()
    for buffer in (0, 1):
        part = sorted((r.buffer_pos, r.chunk_pos, r.block_no) for r in found if r.buffer == buffer)
        assert [p for p, *_ in part] == list(range(12))
        assert {c for _, c, _ in part} == {2 * buffer, 2 * buffer + 1}
        assert [x[1:] for x in part] != sorted(x[1:] for x in part)
    kept = sampling.shuffle_blocks(df, n_chunks=2, shuffle=False)
    assert all(r.buffer_pos == (r.chunk_pos % 2) * 6 + r.block_no for r in kept.collect())


def test_batches(spark):
    found = sampling.number_batches(spark.range(10).withColumnRenamed("id", "pos"), 2, 2)
    assert rows(found, "pos", "iter", "step", "is_accumulating")[:6] == [
        (0, 0, 0, True), (1, 0, 0, True), (2, 1, 0, False), (3, 1, 0, False), (4, 2, 1, True), (5, 2, 1, True)
    ]


# --- reports ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0], [0.3, 0.3], [0.0, 0.1, 1.0], [5.0]])
def test_histogram_is_that_of_numpy(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "domain string, weight double")
    found = stats.histogram(df, "weight", bins=10).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r.n for r in found] == counts.tolist()
    assert [r.lo for r in found] + [found[-1].hi] == pytest.approx(edges.tolist())
    alone = stats.histogram(df, "weight", (), 10).orderBy("bin").collect()
    assert [r.n for r in alone] == counts.tolist()


def test_zero_counts(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0), (1, "b", 1.0), (2, "a", 1e-8), (2, "b", 1e-6), (3, "a", 0.5), (3, "b", 0.5)],
        "index long, domain string, weight double",
    )
    assert rows(stats.zero_counts(df), "domain", "n_zero") == [("a", 2), ("b", 0)]
    assert rows(stats.configs_by_zero_count(df), "n_zero", "n_configs") == [(0, 1), (1, 2)]


def test_spearman_is_that_of_spark_ml(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    chance = random.Random(5)
    df = spark.createDataFrame(
        [("t", float(chance.randint(0, 20)), float(chance.randint(0, 20))) for _ in range(200)], "target string, x double, y double"
    )
    vectors = df.select(array_to_vector(F.array("x", "y")).alias("v"))
    wanted = Correlation.corr(vectors, "v", "spearman").first()[0][0, 1]
    assert stats.spearman(df, "x", "y").first().rho == pytest.approx(wanted)


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.createDataFrame([("d", "t", i, float(i)) for i in range(40)], "domain string, type string, sample_id long, weight double")
    found = stats.mixture_summary(df, 400).first()
    half = 1.96 * np.std(range(40)) / math.sqrt(40)
    assert found.n == 40 and found["mean"] == 19.5
    assert found.lo == pytest.approx(19.5 - half, abs=0.7) and found.hi == pytest.approx(19.5 + half, abs=0.7)


# --- histories -------------------------------------------------------------------------------------------------


def test_first_value_may_stand_in_a_later_row(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("r1", 1, 9, None, 1.0), ("r1", 2, 9, 2.0, None), ("r1", 3, 9, 7.0, 7.0), ("r2", 1, 9, nan, 5.0), ("r3", 1, 8, 1.0, 1.0)],
        "run string, seq long, step long, a double, b double",
    )
    assert rows(history.collect_losses(df, ["a", "b"], 9), "run", "a", "b") == [("r1", 2.0, 1.0)]
    kept = {r.run: (r.a, r.b) for r in history.collect_losses(df, ["a", "b"], 9, enable_empty_row=True).collect()}
    assert kept == {"r1": (2.0, 1.0), "r2": (None, None), "r3": (None, None)}


def test_first_run_of_a_name_wins(spark):
    df = spark.createDataFrame([("n", 2, "late"), ("n", 1, "early"), ("m", 5, None)], "name string, seq long, v string")
    assert {r.name: r.v for r in history.dedup_runs(df).collect()} == {"n": "early", "m": None}


def test_later_value_replaces_an_earlier_one(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0, None), (1, 2, 2.0, 5.0), (1, 3, None, None), (None, 4, 9.0, 9.0)], "step long, seq long, z double, a double"
    )
    merged = history.merge_step_metrics(df)
    assert merged.columns == ["a", "step", "z"] and rows(merged, "a", "step", "z") == [(5.0, 1, 2.0)]


def test_runs_by_prefix(spark):
    df = spark.createDataFrame([("p_n12",), ("p_nx",), ("q_n1",)], "name string")
    assert rows(history.select_runs(df, "p_n"), "name", "index") == [("p_n12", 12)]
    assert rows(history.rejected_runs(df, "p_n"), "name") == [("p_nx",)]


@pytest.mark.parametrize("ignore, denominator, wanted", [(-1, "kept", 2.0), (-1, "all", 4 / 3), (-100, "kept", 11 / 3)])
def test_three_rules_for_ignored_tokens(spark, ignore, denominator, wanted):
    df = spark.createDataFrame([("r", 5, 1.0), ("r", -1, 7.0), ("r", 6, 3.0)], "run string, target int, nll double")
    found = history.masked_mean_loss(df, ignore, denominator).first().mean_loss
    assert found == pytest.approx(wanted)


# --- speed -----------------------------------------------------------------------------------------------------


def monitor_rows(spark):
    data = [("r", i, float(i * i), (i + 1) * 4, (i + 1) * 8, 2, float(i), 10.0 + i, 100.0, 1.0 if i == 1 else None) for i in range(5)]
    return spark.createDataFrame(
        data,
        "run string, iter long, elapsed double, samples long, lengths long, world_size long, loss double, flops double,"
        "peak_flops double, eval_seconds double",
    )


def test_rates_start_with_the_third_row(spark):
    found = {r.iter: r for r in monitor.throughput(monitor_rows(spark)).collect()}
    assert found[0].batches_per_sec is None and found[1].tokens_per_sec is None
    assert found[2].device_batches_per_sec == pytest.approx(2 / 4)
    assert found[4].samples_per_sec == pytest.approx(8 * 2 / 12)
    assert found[4].tokens_per_sec == pytest.approx(8 * 2 / 12 * 8)
    rates = {r.iter: r for r in monitor.compute_rate(monitor_rows(spark)).collect()}
    assert rates[1].mfu is None
    assert rates[2].flops_per_sec == pytest.approx((11 + 12) * 2 / 4)
    assert rates[2].mfu == pytest.approx((11 + 12) / 4 / 100)


def test_rolling_loss_and_times(spark):
    loss = {r.iter: r.train_loss for r in monitor.rolling_train_loss(monitor_rows(spark), 3).collect()}
    assert loss == {0: None, 1: None, 2: 1.0, 3: 2.0, 4: 3.0}
    times = {r.iter: (r.time_val, r.time_total) for r in monitor.time_totals(monitor_rows(spark), "seconds").collect()}
    assert times == {0: (0.0, 0.0), 1: (1.0, 2.0), 2: (1.0, 5.0), 3: (1.0, 10.0), 4: (1.0, 17.0)}
    assert rows(monitor.every_kth(monitor_rows(spark), 2), "iter") == [(0,), (2,), (4,)]
    with pytest.raises(ValueError):
        monitor.time_totals(monitor_rows(spark), "weeks")


def test_windows_look_back_over_gaps_in_iterations(spark):
    """Numbers skipped before, at and far beyond the border of a bucket, and a run that does not start at 0."""
    iters = [3, 4, 9, 65533, 65534, 65540, 65541, 200_000, 131_072 * 3, 10**7]
    data = [("r", it, float(k * k), (k + 1) * 4, (k + 1) * 8, 2, float(k), 10.0 + k, 100.0, None) for k, it in enumerate(iters)]
    gapped = spark.createDataFrame(data, monitor_rows(spark).schema)
    dense = spark.createDataFrame([("r", k, *row[2:]) for k, row in enumerate(data)], gapped.schema)
    place = {it: k for k, it in enumerate(iters)}
    for work in (monitor.throughput, lambda df: monitor.rolling_train_loss(df, 3), monitor.compute_rate):
        found = {place[r.iter]: r[2:] for r in work(gapped).collect()}
        assert found == {r.iter: r[2:] for r in work(dense).collect()}
        assert set(work(gapped).columns).isdisjoint({"_place", "_bucket"})
    assert {r.iter: r.train_loss for r in monitor.rolling_train_loss(gapped, 3).collect()}[65540] == 4.0


def test_device_classes(spark):
    df = spark.createDataFrame(
        [("NVIDIA H100 80GB HBM3", "8-true"), ("NVIDIA H100 PCIe", "32-true"), ("Tesla T4", "bf16-true"), ("v3", "any"), ("x", "32-true")],
        "device_name string, precision string",
    )
    found = {r.device_name: (r.device, r.peak_flops) for r in monitor.with_peak_flops(df).collect()}
    assert found == {
        "NVIDIA H100 80GB HBM3": ("h100-sxm", 1.979e15),
        "NVIDIA H100 PCIe": ("h100-pcie", 51e12),
        "Tesla T4": ("t4", None),
        "v3": ("v3", 123e12),
        "x": (None, None),
    }


# --- runs and models -------------------------------------------------------------------------------------------


def test_sizes_follow_only_with_a_batch_size(spark):
    df = spark.createDataFrame(
        [(1, {"max_step": "10"}), (2, {"max_step": "10", "global_batch_size": "64", "micro_batch_size": "2", "x": "1"}), (3, None)],
        "index long, params map<string,string>",
    )
    found = {r["index"]: r for r in runs.resolve_params(df).collect()}
    assert (found[1].max_iters, found[1].resolved["max_step"]) == (25000 * 16, "10")
    assert (found[2].batch_size, found[2].gradient_accumulation_steps, found[2].max_iters) == (8, 4, 40)
    assert "x" not in found[2].resolved and found[3].warmup_iters == 16000


def test_plan_flags_overuse(spark):
    mix = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.0)], "index long, domain string, weight double")
    dist = spark.createDataFrame([("a", 10**9), ("b", 10**7)], "domain string, n_tokens long")
    found = {r.domain: (r.sequences, r.over_cap) for r in runs.training_plan(mix, dist).collect()}
    assert found == {"a": (256000.0, False), "b": (256000.0, True), "c": (0.0, False)}


def test_patience():
    assert regression.stop_round([5, 4, 3, 3, 3, 3, 1]) == 2
    assert regression.stop_round([5, 4, 6, 6, 3, 9]) == 4
    assert regression.stop_round([1]) == 0


def test_linear_models_are_least_squares(spark):
    chance = random.Random(2)
    data = [(i, chance.random(), chance.random()) for i in range(60)]
    table = spark.createDataFrame([(i, a, b, 1 + 2 * a - 3 * b + chance.gauss(0, 0.1)) for i, a, b in data], "index long, a double, b double, y double")
    model = regression.fit_linear(regression.assemble(table, ["a", "b"]), ["y"])["y"]
    y = np.array([r.y for r in table.orderBy("index").collect()])
    wanted, *_ = np.linalg.lstsq(np.array([[1, a, b] for _, a, b in data]), y, rcond=None)
    assert [model.intercept, *model.coefficients] == pytest.approx(wanted.tolist())
    assert (model.n, model.rank) == (60, 2)


def test_weights_that_add_up_to_one_have_unique_predictions(spark):
    chance = random.Random(3)
    data = []
    for i in range(80):
        shares = [chance.expovariate(1) for _ in range(4)]
        data.append((i, *[v / sum(shares) for v in shares], 0.0, 1500 + 4 * chance.random() + shares[0], chance.random()))
    names = ["a", "b", "c", "d", "never"]
    table = spark.createDataFrame(data, "index long, a double, b double, c double, d double, never double, y double, z double")
    odd = spark.createDataFrame([(-1, 1.0, 0.0, 0.0, 0.0, 0.0, None, 1.0), (-2, 1.0, 0.0, 0.0, 0.0, 0.0, float("nan"), 1.0)], table.schema)
    whole = regression.assemble(table, names).repartition(5)
    models = regression.fit_linear(whole.unionByName(regression.assemble(odd, names)), ["y", "z"])
    x = np.array([[1, *row[1:6]] for row in data])
    for place, target in ((6, "y"), (7, "z")):
        y = np.array([row[place] for row in data])
        wanted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        found = [r.prediction for r in models[target].transform(whole).orderBy("index").collect()]
        assert found == pytest.approx(wanted.tolist(), abs=1e-9)
        assert (models[target].n, models[target].rank) == (80, 3)
        assert models[target].squared_error == pytest.approx(((y - wanted) ** 2).sum(), rel=1e-6)
        assert models[target].r2 == pytest.approx(1 - ((y - wanted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6)
    with pytest.raises(ValueError, match="no rows"):
        regression.fit_linear(whole.limit(0), ["y"])


def test_boosting_ranks_unseen_mixtures(spark):
    chance = random.Random(4)
    data = [(i, x, 1 - x, (x - 0.3) ** 2) for i, x in enumerate(chance.random() for _ in range(150))]
    table = regression.assemble(spark.createDataFrame(data, "index long, a double, b double, y double"), ["a", "b"]).coalesce(1)
    fit, stop, score = regression.split_sets(table, (0.6, 0.2, 0.2))
    assert fit.count() + stop.count() + score.count() == 150
    model = regression.fit_boosted(fit, stop, ["y"], rounds=15, rate=0.3)["y"]
    scored = regression.predict(model, score).withColumn("target", F.lit("y"))
    assert stats.spearman(scored, "prediction", "y").first().rho > 0.9


# --- faults found in review --------------------------------------------------------------------------------------


def test_names_without_number_keep_their_domain(spark):
    from blendwise.functions.names import domain_of, shard_of

    names = ["arxiv-part.jsonl", "github.jsonl", "pile_cc-12.jsonl", "a-b-3_x.jsonl"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    found = {r.path: (r.d, r.s) for r in df.select("path", domain_of(F.col("path")).alias("d"), shard_of(F.col("path")).alias("s")).collect()}
    assert found == dict(zip(names, [("arxiv", None), ("github", None), ("pile_cc", 12), ("a-b", 3)]))


def test_run_parameters_are_not_lost(spark):
    given = {"model_name": "m", "decay_lr": "False", "data_seed": "7", "colour": "blue"}
    rows_ = spark.createDataFrame([(1, given)], "index int, params map<string,string>")
    resolved = runs.resolve_params(rows_).collect()[0].resolved
    assert [resolved.get(k) for k in given] == ["m", "False", "7", None]
    small = spark.createDataFrame([(1, {"global_batch_size": "8", "micro_batch_size": "16"})], "index int, params map<string,string>")
    with pytest.raises(PySparkException, match="smaller than a micro-batch"):
        runs.resolve_params(small).collect()


def test_unlisted_domains_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "zz", 0.5)], "index int, domain string, weight double")
    with pytest.raises(PySparkException, match="not listed: zz"):
        weights.to_wide(df, ["a"]).collect()
    assert weights.to_wide(df, ["a", "zz"]).collect()[0].zz == 0.5


def test_full_chunk_at_the_end_of_a_file_is_kept(spark):
    docs = spark.createDataFrame([("d", 0, 0, [1, 2]), ("d", 0, 1, [3, 4])], "domain string, shard int, doc_id int, tokens array<int>")
    assert sorted(r.tokens for r in packing.pack_chunks(docs, 2).collect()) == [[1, 2], [3, 4]]


def test_first_trees_predict_like_a_shorter_fit(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import GBTRegressor

    from blendwise.operators import regression

    rows_ = [(i, Vectors.dense([i % 7, i % 3]), float(i % 7) ** 2) for i in range(60)]
    df = spark.createDataFrame(rows_, ["index", "features", "y"])
    long, short = (GBTRegressor(labelCol="y", maxIter=n, stepSize=0.1, maxDepth=2, seed=1).fit(df) for n in (6, 3))
    cut = regression.first_trees(long, 3)
    assert [r.prediction for r in cut.transform(df).collect()] == [r.prediction for r in short.transform(df).collect()]


def test_residual_products_show_domains_left_out_of_a_fit(spark):
    rows = [(i, (i % 7) / 10, (i * i % 11) / 20, 3 + (i % 7) * 2.0 - (i * i % 11) + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "index long, a double, b double, loss double")
    whole = regression.assemble(df, ["a", "b"])
    for names, zero in ((["a", "b"], True), (["a"], False)):
        model = regression.fit_linear(regression.assemble(df, names), ["loss"])["loss"]
        scored = replace(model, features="some").transform(regression.assemble(whole, names, "some"))
        got = {r.feature: r for r in regression.residual_products(scored, "loss", ["a", "b"]).collect()}
        assert set(got) == {"a", "b", "intercept"} and all(r.n == 60 for r in got.values())
        assert (abs(got["b"].residual) < 1e-9) == zero
        assert abs(got["a"].residual) < 1e-9 and abs(got["intercept"].residual) < 1e-9
