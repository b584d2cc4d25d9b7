"""The corpus operators against brute force, round trips, and odd input."""

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendwise.llm import decontamination, jaccard, language, neighbours, packing, pii, quality, sharding, toxicity, urls
from blendwise.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def frame(spark, texts, extra=()):
    """Documents 0, 1, … and some extra columns whose names clash with those used inside."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


CLASH = ("n", "hash", "words", "class_id", "key", "size", "shard", "slot", "score", "ids", "_keep_id", "item_id", "place")
ODD = [None, "", " \n\t", "a", "a", "...", "é", "x " * 30000, "word", None]


# --- components ------------------------------------------------------------------------------------------------


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (None, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in range(7, 60)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------------


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    w, covered, found = words(text), set(), set()
    for item, other in items:
        v = words(other)
        size = min(13, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                covered |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(covered), sorted(found)


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [f"w{i}" for i in range(40)] + ["É", "É"]
    text = lambda n: " ".join(rng.choice(pool, n))
    items = [(i, text(n)) for i, n in enumerate([40, 13, 14, 5, 1, 0, 60, 12])] + [(8, None), (2, text(30)), (None, text(20))]
    docs = [text(n) for n in rng.integers(0, 80, 60)]
    docs += [f"{text(9)}, {items[0][1].upper()}! {text(3)}", items[1][1], items[3][1], f"{text(30)} {items[2][1]}", *ODD]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontamination.contamination(frame(spark, docs, CLASH), bench).collect()
    known = [(i, t) for i, t in items if i is not None]
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == {
        i: brute_hits(t, known) for i, t in enumerate(docs)
    }
    kept = decontamination.drop_contaminated(frame(spark, docs, CLASH), bench)
    clean = {i for i, t in enumerate(docs) if not (b := brute_hits(t, known))[1] or 20 * b[1] < b[0]}
    assert {r.doc_id for r in kept.collect()} == clean
    assert len(kept.columns) == 5 + len(CLASH)


@pytest.mark.parametrize("kind", ["equal", "two", "three", "seven", "twice"])
def test_contamination_of_repeated_words_at_every_offset(spark, kind):
    """Equal grams within a window must be chosen alike wherever the window stands."""
    period = {"equal": 1, "two": 2, "three": 3, "seven": 7}
    docs, items = [], []
    for k in range(8):
        if kind == "twice":
            item = [f"g{k}x{i}" for i in range(13)]
            item[7:12] = item[:5]
        else:
            item = [f"p{k}x{i % period[kind]}" for i in range(13)]
        items.append((f"i{k}", " ".join(item)))
        docs += [" ".join([f"b{k}n{i}" for i in range(before)] + item + ["end"]) for before in range(32)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.contamination(frame(spark, docs), bench).collect()
    want = {i: brute_hits(d, items) for i, d in enumerate(docs)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == want
    assert all(r.n_hit == 13 for r in got)


def test_contamination_of_repeated_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = frame(spark, ["x a b c", "y"])
    twice = docs.union(docs)
    assert sorted((r.doc_id, r.n_hit) for r in decontamination.contamination(twice, bench).collect()) == [
        (0, 3), (0, 3), (1, 0), (1, 0)
    ]
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert [r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()] == [0, 0]
    assert decontamination.drop_contaminated(twice, bench).count() == 2


# --- Jaccard join ------------------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts():
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary, 12))
    texts = []
    for size in [4, 5, 6, 8, 9, 10, 14, 25, 40, 80, 200] * 3:
        base = list(rng.choice(vocabulary, size))
        texts.append(" ".join(base))
        for edits in rng.integers(0, 5, 6):
            copy = base[:]
            for at in rng.integers(0, size, edits):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy[: size - int(rng.integers(0, 2))]))
        texts.append(passage + " " + " ".join(rng.choice(vocabulary, size)))
    return texts + [texts[5].upper()] * 4


@pytest.mark.parametrize("boundary", [None, 0, 20, 10**6])
def test_near_duplicates_equal_brute_force(spark, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 6)
    texts = near_texts() + ODD
    got = jaccard.near_duplicates(frame(spark, texts, CLASH), boundary=boundary).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_one_document_of_each_component_stays(spark):
    texts = near_texts()[:60] + ODD
    docs = frame(spark, texts, CLASH)
    kept = jaccard.drop_near_duplicates(docs.union(docs))
    expected = brute_components(texts)
    found = sorted(r.doc_id for r in kept.collect())
    alone = [i for i, (n, root) in expected.items() if n and i == root]
    assert found == sorted(alone + 2 * [i for i, (n, _) in expected.items() if not n])
    assert kept.columns == docs.columns
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4, 64])
def test_one_large_group_of_near_copies(spark, crowd, monkeypatch):
    """Copies of one text with few to many edits: crowded cells lose no link, and pairs do not grow with its square."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i, edits in enumerate(rng.integers(1, 9, 150)):
        copy = base[:]
        for at in rng.integers(0, len(base), edits):
            copy[at] = f"x{i}-{at}" if i % 3 else f"y{i % 7}-{at}"
        texts.append(" ".join(copy))
    compared = []
    overlaps = jaccard.overlaps

    def counted(pairs, whole, percent):
        compared.append(pairs.count())
        return overlaps(pairs, whole, percent)

    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "overlaps", counted)
    got = jaccard.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)
    assert sum(compared) < len(texts) ** 2 / 4


def test_documents_without_id_are_deduplicated_too(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d e f"), (1, "d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard.drop_near_duplicates(docs).collect() if r.doc_id) == [(1, "d e f")]
    assert jaccard.drop_near_duplicates(docs).count() == 2


# --- packing -----------------------------------------------------------------------------------------------------


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["Hello, World! it's 42 ÄÖ é", "tab\tnew\nline  x", "naïve – dash…", "ﬁ ΣΑΣ İ", *ODD] * 3
    rows = packing.pack_documents(frame(spark, texts, CLASH), window=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        whole = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        parts = sorted(pieces[i])
        assert [t for _, ids, _ in parts for t in ids] == whole
        assert all(n == len(whole) for _, _, n in parts)
        assert [s for s, _, _ in parts] == list(np.cumsum([0] + [len(ids) for _, ids, _ in parts])[:-1])
    short = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64 and end & (end - 1) == 0
        short += end < 64
    assert short <= 6 * 8
    assert packing.pack_documents(frame(spark, texts).limit(0)).count() == 0


def test_ids_are_those_of_the_tokenizer_whatever_came_before():
    encoder = packing.Encoder(packing.tokenizer_path())
    texts = ["# % & $ - it's 3d naïve", "#. %, &! $; -. It's. 3D, naïve! Straße? e.g. a.b 's. ..., ÄÖ: ﬁn x². \x1f \u00a0."] + ["", None, " "]
    encoder.encode(["#", "%", "&", "$", "-"])
    for text, found in [(t, encoder.encode([t])[0]) for t in texts] + list(zip(texts, encoder.encode(texts))):
        wanted = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found, encoder.kind).tolist() == [*wanted, packing.END_ID]
    assert encoder.encode([]) == []


def test_ids_without_word_ends_in_the_vocabulary(monkeypatch):
    encoder = packing.Encoder(packing.tokenizer_path())
    wanted = encoder.encode(["plain wörds only"])
    other = packing.Encoder(packing.tokenizer_path())
    other.last[:] = False
    assert other.encode(["plain wörds only"]) == wanted


def test_bucket_rows_do_not_repeat_the_work_of_a_set(spark):
    sets = spark.createDataFrame([(1, 9, 9, 9, 0, [(2, 5), (3, 7)])], f"class_id long, n long, m long, na long, own long, front {jaccard.FRONT}")
    plan = jaccard.buckets(sets, 100, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(" in plan and "aggregate(" not in plan[: plan.rindex("Generate explode(")]


def test_bm25_ranks_like_the_formula():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 30, n).astype(np.uint16) for n in (5, 20, 40, 7, 13)]
    idf = rng.random(30).astype(np.float32)
    shard = packing.Shard([[None, i, 0, None] for i in ids], idf, 11.0)
    got = shard.scores(np.unique(ids[1]))
    for doc, terms in enumerate(ids):
        want = 0
        for t in np.unique(ids[1]):
            tf = (terms == t).sum()
            want += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / 11.0))
        assert got[doc] == pytest.approx(want, rel=1e-5)


# --- neighbours ----------------------------------------------------------------------------------------------------


def test_nearest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_NUMBERS", 400)
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 1, (300, 5))
    vectors[40:80] = vectors[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(300, None), (320, [0.0] * 5), (340, [1.0, None, 0.0, 0.0, 0.0]), (360, [float("nan")] * 5), (380, [float("inf")] * 5), (400, []), (420, [1.0, 2.0])]
    df = spark.createDataFrame(rows + rows[:9] + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        scores = neighbours.products(np.repeat(vectors[q : q + 1], 300, 0), vectors)
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
        assert found == [(i, -s) for s, i in want]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2.0), (2, -3.0)]


# --- urls ----------------------------------------------------------------------------------------------------------


def test_urls_rules_and_aliases(spark):
    link = '<html><LINK rel="canonical" href="{}"></html>'.format
    pages = [
        (0, "http://www.example.com/en/1", None, "www.example.com/en/", "allow"),
        (1, "http://A.Example.com/en/1?q", "", "example.com/en/", "block"),
        (2, "http://com/x", None, "com/", "allow"),
        (3, "https://b.net/fr/", None, "net/fr/", "block"),
        (4, "https://b.net/de/", link("https://b.net/fr/"), None, "block"),
        (5, "https://c.org/a/b", '<meta http-equiv="refresh" content="0; url=/c">', None, "block"),
        (6, "https://c.org/c/", link("//b.net/de"), None, "block"),
        (7, "https://d.org/", "<!-- " + link("https://b.net/fr/") + " -->", None, "allow"),
        (8, "https://www.example.com/en/9", link("https://b.net/fr/"), "www.example.com/en/", "allow"),
        (9, None, link("https://b.net/fr/"), None, "allow"),
        (10, "no scheme", None, None, "allow"),
        (11, "http://com", None, None, "allow"),
        (12, "https://e.org/x", link("https://f.net/es/1"), None, "block"),
        (12, "https://e.org/x", link("https://f.net/es/1"), None, "block"),
        (13, "https://xcom/", None, None, "allow"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").withColumn("host", F.lit("h"))
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(df).collect())
    assert got == sorted((p[0], p[3], p[4]) for p in pages)
    parts = {r.page_id: (r.host, r.path) for r in urls.judge_urls(df).collect()}
    assert parts[1] == ("a.example.com", "/en/1") and parts[9] == ("", "") and parts[11] == ("com", "")
    assert urls.judge_urls(df.limit(0)).count() == 0
    moved = spark.createDataFrame([("http://d.org", "http://b.net/es/")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(df, moved).collect()}[7] == "block"


def test_urls_with_queries_are_pages_of_their_own(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (0, "http://a.org/index.php?id=1", link("https://b.net/fr/"), "block"),
        (1, "http://a.org/index.php?id=2", None, "allow"),
        (2, "http://a.org/index.php", None, "allow"),
        (3, "http://a.org/index.php?id=1#part", None, "block"),
        (4, "http://a.org/watch?v=1&amp;w=2", None, "allow"),
        (5, "http://a.org/watch?v=1&w=2", link("http://c.org/go?to=1&amp;from=2"), "block"),
        (6, "http://c.org/go?to=1&from=2", link("//b.net/fr/"), "block"),
        (7, "http://c.org/go?to=2&from=2", None, "allow"),
        (8, "http://d.org/x/y?p=1", link("?p=2"), "block"),
        (9, "http://d.org/x/y?p=2", link("http://b.net/fr/?q"), "block"),
        (10, "http://d.org/x/y?p=3", link("#top"), "allow"),
        (11, "http://e.org/in", link("/login?next=http://b.net/fr/"), "allow"),
        (12, "http://f.org/?id=3", None, "block"),
        (13, "http://f.org/?id=4", None, "allow"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://f.org?id=3", "http://a.org/index.php?id=1")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(df, moved).collect()}
    assert got == {p[0]: p[3] for p in pages}


# --- language, toxicity, quality -------------------------------------------------------------------------------------


def corpus(spark, folder="/root/testdata/sf0.1"):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def fold(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def test_language_on_held_out_documents(spark):
    docs, _ = corpus(spark)
    model = language.train(docs.where(fold(5) != 0), 200)
    held = docs.where(fold(5) == 0)
    found = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert right.a > 0.99 and 0 <= right.lo <= right.hi <= 1
    odd = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, ODD, CLASH), model).collect()}
    assert [odd[i] for i in (0, 1, 2, 5)] == ["und"] * 4 and odd[3] != "und"
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(frame(spark, ODD), empty).collect()} == {"und"}


def test_temperature_undoes_a_known_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 1, (4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert language.fit_temperature(logits * 4, labels) == pytest.approx(4, rel=0.2)


def test_network_gradients_are_right():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(0, 1, (6, 3, 2 * toxicity.EMBED))
    mask = (np.arange(6)[:, None] < np.array([6, 4, 1])).astype(np.float64)

    def value():
        return float((net.forward(net.project(x), mask, keep=True)[0] * np.array([1.0, -2.0, 0.5])).sum())

    _, cache = net.forward(net.project(x), mask, keep=True)
    grads, dx = net.gradients(x, mask, np.array([1.0, -2.0, 0.5]), cache)
    for array, grad in [(net.p[k], grads[k]) for k in grads] + [(x, dx)]:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 1e-3
            up = value()
            array[at] = old - 1e-3
            slope = (up - value()) / 2e-3
            array[at] = old
            assert grad[at] == pytest.approx(slope, rel=0.05, abs=2e-3)


def test_toxicity_on_planted_words(spark):
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("ing", "ed", "le", "sh", "nt", "ea")]
    bad = ["idiot", "moron", "vequa", "vequir", "veques"]
    texts = [list(rng.choice(clean, n)) for n in rng.integers(5, 150, 600)]
    toxic = rng.random(600) < 0.3
    for text, t in zip(texts, toxic):
        if t:
            text[int(rng.integers(0, len(text)))] = rng.choice(bad)
    docs = frame(spark, [" ".join(t) for t in texts])
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 500"), labels.where("doc_id < 500"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == toxic[i] for i in range(500, 600)]) >= 0.95
    odd = {r.doc_id: r.score for r in toxicity.score(frame(spark, ODD, CLASH), model).collect()}
    assert odd[0] == odd[1] == odd[5] == 0 and all(0 <= s <= 1 for s in odd.values())
    kept = toxicity.drop_toxic(frame(spark, [*ODD, "you idiot moron"], CLASH), model)
    assert kept.columns == frame(spark, ODD, CLASH).columns
    assert len(ODD) not in {r.doc_id for r in kept.collect()}
    prior = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(3), prior).collect()} == {0.0}


def test_windows_cover_every_word_and_overlap():
    for n in (1, 31, 32, 33, 48, 49, 100, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.5, 0.8, 0.97])
def test_prior_of_a_known_mixture(prior):
    rng = np.random.default_rng(7)
    good = lambda n: rng.normal(0.7, 1, (n, quality.FEATURES))
    web = np.concatenate([good(int(8000 * prior)), rng.normal(-0.7, 1, (8000 - int(8000 * prior), quality.FEATURES))])
    assert quality.estimate_prior(good(3000), rng.permutation(web)) == pytest.approx(prior, abs=0.05)


def test_prior_without_enough_rows():
    x = np.zeros((1, quality.FEATURES))
    assert quality.estimate_prior(x, np.zeros((9, quality.FEATURES))) == quality.DEFAULT_PRIOR
    assert quality.estimate_prior(x[:0], x[:0]) == quality.DEFAULT_PRIOR
    assert 0 < quality.estimate_prior(np.zeros((6, quality.FEATURES)), np.zeros((6, quality.FEATURES))) <= 1


def test_quality_on_held_out_documents(spark):
    docs, labels = corpus(spark)
    learn = fold(3) != 1
    model = quality.train(docs.where(learn), labels.where(learn))
    flipped = labels.withColumn("quality", F.when(F.col("quality") == 1, 1))  # bad labels are not looked at
    again = quality.train(docs.where(learn), flipped.where(learn))
    assert abs(quality.score(docs, again).where("score >= 0.5").count() - quality.score(docs, model).where("score >= 0.5").count()) < 100
    held = docs.where(fold(3) == 1)
    found = quality.score(held, model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in quality.score(frame(spark, ODD, CLASH), model).collect())
    assert quality.train(docs, labels.limit(0)) == quality.DEFAULT_PRIOR
    assert quality.score(docs.limit(0), model).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------


def brute_spans(text):
    found = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_plain_identifiers_equal_the_patterns():
    rng = np.random.default_rng(4)
    alphabet = list("aZ9.0@-+ ()1234") + ["@a.b", "1.2.3.4", "+49 ", "4111111111111111", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.personal_data(text)[0] == brute_spans(text), text


@pytest.mark.parametrize(
    ("text", "part", "kind"),
    [
        ("mail john [at] mail [dot] com now", "john [at] mail [dot] com", "email"),
        ("mail john at mail dot com now", "john at mail dot com", "email"),
        ("mail jоhn@mail.com now", "jоhn@mail.com", "email"),
        ("write ａｂ＠mail．com ok", "ａｂ＠mail．com", "email"),
        ("call plus four nine one five one two three four five six seven now", "plus four nine one five one two three four five six seven", "phone"),
        ("ip one nine two dot one six eight dot zero dot one end", "one nine two dot one six eight dot zero dot one", "ip"),
        ("card ４１１１ 1111 1111 1111.", "４１１１ 1111 1111 1111", "card"),
        ("a​b@mail​.com", "a​b@mail​.com", "email"),
    ],
)
def test_disguises_map_back_to_the_source(text, part, kind):
    base, spans = pii.personal_data(text)
    assert any(text[s:e] == part and k == kind for s, k, e in spans), spans
    assert set(base) <= set(spans)
    assert part not in pii.redact(text, spans)


@pytest.mark.parametrize(
    ("part", "kind"),
    [
        ("192[.]168[.]0[.]17", "ip"),
        ("192 dot 168 dot 0 dot 17", "ip"),
        ("192 (dot) 168 { . } 0<dot>17", "ip"),
        ("192dot168DOT0 point 255", "ip"),
        ("192.168.one.17", "ip"),
        ("192 dot one 68 dot zero dot 1 seven", "ip"),
        ("+1 555 one two three 4567", "phone"),
        ("+1 (555) one two three 4567", "phone"),
        ("+49 one seven zero 1234567", "phone"),
        ("plus 49 one 70 12 three 4567", "phone"),
        ("+49 170 12345 six seven", "phone"),
        ("4111 one one one one 1111 1111", "card"),
        ("four 111 1111 1111 one 111", "card"),
        ("a.b.c.d.e [at] site [dot] org", "email"),
        ("a dot b dot c dot d dot e dot f at site dot org", "email"),
    ],
)
def test_mixed_disguises_are_found_whole(part, kind):
    for text in (part, f"see {part} two days ago", f"x: {part}; 12 and one."):
        base, spans = pii.personal_data(text)
        at = text.index(part)
        assert any(k == kind and s <= at and at + len(part) <= e for s, k, e in spans), (text, spans)
        assert set(base) <= set(spans)


def test_plain_numbers_beside_words_stay_as_they_are():
    for text in ("from 10.0.0.1 one of two", "in 2019, one 2020 and two 12 of 3 point 5", "seven 10.0.0.1"):
        base, spans = pii.personal_data(text)
        assert base == spans
    slow = ["9" * 200_000, "a dot " * 50_000, "a." * 100_000 + " [at] ", "1 two " * 30_000, "1 " * 100_000 + "one"]
    assert all(pii.redact(t, pii.personal_data(t)[1]) is not None for t in slow)


def test_prose_is_left_alone():
    for text in ("we met at example.com today", "one or two at a time, three dot", "Привет мир", "Ἀθήνα 3.5", "look at this. dot", "five six"):
        assert pii.personal_data(text) == ([], [])


def test_redaction_keeps_rows_columns_and_lengths(spark):
    texts = ["x a@b.co y", *ODD, "9" * 5000, "a" * 100_000 + "@"]
    docs = frame(spark, texts, ("spans", "base", "redacted"))
    rows = {r.doc_id: r for r in pii.redact_documents(docs).collect()}
    assert rows[0].text == "x <EMAIL> y" and rows[0].n_chars == 11 and rows[0].spans == "x"
    assert [rows[i].text for i in range(1, len(texts))] == texts[1:]
    found = {r.doc_id: r for r in pii.find_personal_data(docs, redacted=True).collect()}
    assert found[0].redacted == "x <EMAIL> y" and [tuple(s) for s in found[0].spans] == [("email", 2, 8)]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------


def test_shards_are_balanced_gapless_and_mostly_stable(spark):
    texts = [f"text {i % 700}" for i in range(2000)] + ODD
    docs = frame(spark, texts, ("arc", "rank"))

    def places(shards, n=None):
        rows = sharding.shard_documents(docs if n is None else docs.where(F.col("doc_id") < n), shards, 32, 100).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        return {r.doc_id: r.shard for r in rows}

    eight, nine = places(8), places(9)
    assert len(eight) == len(texts)
    assert np.mean([eight[i] != nine[i] for i in eight]) < 0.5
    assert np.mean([eight[i] != s for i, s in places(8, 1990).items()]) < 0.1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_overflow_continues_clockwise():
    plan = sharding.overflow_plan([5, 1, 0, 2], [0, 1, 0, 2], 3)
    placed = defaultdict(int)
    for arc, lo, hi, shard, _ in plan:
        placed[shard] += hi - lo
    assert dict(placed) == {0: 3, 1: 3, 2: 2}
    assert (0, 3, 5, 1, 1) in plan


def test_shards_write_whole_texts(spark, tmp_path):
    docs = frame(spark, ["b", "a", "c", None])
    assigned = sharding.shard_documents(docs, 2, 8, carry=("text",))
    sharding.write_shards(assigned, str(tmp_path / "out"))
    assert sorted(str(r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "a", "b", "c"]
    with pytest.raises(ValueError):
        sharding.shard_documents(docs.withColumn("slot", F.lit(1)), carry=("slot",))
