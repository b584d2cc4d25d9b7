"""Phrases, vector codes and quality rules against plain Python, odd input included."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendwise.llm import codes, collocations, jaccard, language, rules
from tests.llm.test_llm import CLASH, ODD, frame


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


# --- phrases ---------------------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_collocations(rows, least, best):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often, kept = {p for p in f if f[p] >= least}, []
        for p in often:
            if len(p) < 2:
                continue
            inside = (q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(f[q] >= f[p] for q in inside):
                continue
            score, _, l, r = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def prose(seed, n=60):
    """Few words, so that phrases repeat; long pieces, copies, and runs of one word."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "Dé", "e'f", " x", "zz", "#1"]
    texts = []
    for _ in range(n):
        marks = rng.choice([" ", " ", ", ", "\n", "\t", "  ", ".", "\r\n"])
        run = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        texts.append(marks.join([run, "b c Dé e'f zz", " ".join(rng.choices(words, k=3))]))
    return texts + ["a " * 500, "b c " * 300, texts[0]] + texts[:10]


@pytest.mark.parametrize("least,best", [(5, 1000), (20, 7)])
def test_collocations_equal_brute_force(spark, least, best):
    texts = prose(1) + ODD
    rows = [(("en", None, "de")[i % 3], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for name in ("phrase", "n", "f", "i", "words", "rank"):
        docs = docs.withColumn(name, F.lit("x"))
    got = sorted(map(tuple, collocations.collocations(docs, least, best).collect()))
    assert got == brute_collocations(rows, least, best) and got
    assert collocations.collocations(docs.limit(0), least).count() == 0


def test_chunks_hold_every_phrase_once():
    rng = random.Random(3)
    words = [str(rng.randint(0, 30)).encode() for _ in range(3000)]
    found, spans = Counter(), list(collocations.chunks_of(words))
    assert len(spans) > 100 and [ends for _, ends in spans].count(True) == 1
    for chunk, ends in spans:
        own = len(chunk) if ends else len(chunk) - collocations.OVERLAP
        for i in range(own):
            found.update(tuple(chunk[i : i + k]) for k in range(1, 6) if i + k <= len(chunk))
    assert found == Counter(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    again = Counter(b" ".join(c) for c, _ in collocations.chunks_of(words + words))
    assert sum(n > 1 for n in again.values()) > 100  # the copy gives the same chunks


def test_a_full_bit_table_loses_and_adds_nothing(spark, monkeypatch):
    rows = [("en", t) for t in prose(2)]
    monkeypatch.setattr(collocations, "BITS", 64)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 5).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 5, 2000)


# --- codes -----------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] and all(x is not None and isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    whole = lambda x: int(x) * 4096 if abs(x) > 1e15 else floor(4096 * x)
    start = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        start.setdefault(i, v)
    length = len(start[min(start)])
    kept = [(i, [whole(x) for x in v], label) for i, v, label in kept if len(v) == length]
    seeds = [[whole(x) for x in start[i]] for i in sorted(i for i in start if len(start[i]) == length)[:entries]]
    w = length // parts
    books = [[s[p * w : (p + 1) * w] for s in seeds] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for j in range(len(seeds)):
                mine = [v[p * w : (p + 1) * w] for (_, v, _), f in zip(kept, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    sums = Counter()
    for (_, _, label), f in zip(kept, found):
        sums[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda n: n if n < 1 << 63 else None
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(
        (
            (i, "".join(f"{j:02x}" for _, j in f), fit(sum(d for d, _ in f)), fit(sums[label]), digest)
            for (i, _, label), f in zip(kept, found)
        ),
        key=key,
    )


def vector_rows(n, width, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 1, width), 2)], int(i) % 3 if i % 7 else None) for i in range(n)]
    rows[40:80] = [(i, rows[40][1], 1) for i in range(40, 80)]  # one vector many times
    return rows + rows[:5]


def run_codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).withColumn("vector", F.lit(2))
    return sorted(map(tuple, codes.compress_vectors(df).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("n,width,batch", [(300, 16, 50), (10, 8, 1000)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, width, batch):
    monkeypatch.setattr(codes, "BATCH", batch)
    odd = [(900, None, 1), (901, [None] + [1.0] * (width - 1), 1), (902, [float("nan")] * width, 1), (903, [], 1)]
    odd += [(904, [float("-inf")] * width, None), (905, [1.0] * (width + 8), 1), (906, [1.0] * 3, 2), (None, [0.5] * width, None)]
    rows = (vector_rows(n, width) if n > 100 else vector_rows(300, width)[:n]) + odd
    assert run_codes(spark, rows) == brute_codes(rows)


def test_codes_of_huge_components_stay_exact(spark):
    rows = vector_rows(90, 8)[:90] + [(200 + i, [3e30 * (i + 1), -1e18] * 4, 9) for i in range(4)]
    assert run_codes(spark, rows) == brute_codes(rows)


def test_codes_of_no_rows(spark):
    assert run_codes(spark, [(1, None, 1)]) == []


def test_the_ball_skips_no_nearer_entry():
    rng = np.random.default_rng(2)
    for _ in range(50):
        points, book = rng.integers(-9, 9, (200, 3)), rng.integers(-9, 9, (16, 3))
        want = codes.nearest_entries(points, book, None)
        got = codes.nearest_entries(points, book, rng.integers(0, 16, 200))
        assert all((a == b).all() for a, b in zip(want, got))


# --- quality rules -----------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_equal_plain_python(spark):
    rng = random.Random(4)
    texts = ["a b " * 40, "x y z w " * 20 + "\n" + "q" * 60, "a\n\nb\na\n b\nb", "ß # | é", "w " * 30000, " ".join(map(str, range(30000)))]
    texts += ["\n".join(" ".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += [" a b\x85c \x1c d", *ODD, texts[0]]
    clash = {"own", "kinds", "t", "ref_lang", "common", "kept", "n_words", *CLASH}
    docs = frame(spark, texts, sorted(clash)).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = [(r.doc_id, tuple(r[f] for f in fields), r.kept) for r in rules.judge_quality(docs).collect()]
    assert sorted(g[:2] for g in got) == [(i, brute_rules(t)) for i, t in enumerate(texts)]
    assert not any(kept and base[-1] for _, base, kept in got)
    assert rules.judge_quality(docs.limit(0)).count() == 0


def test_kinds_and_common_words_equal_plain_counts(spark):
    texts = ["", " \t ", "ab  cd\tEF 12.;#*\n\r\x0b~é\u00a0\x7f\x01", "A b\ta \t b", "the thé THE the, the\n the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    kinds = df.select("i", rules.kinds_of(F.col("t")).alias("k"))
    for r in kinds.collect():
        rest, wanted = texts[r.i], []
        for _, pattern in rules.KINDS:
            less = re.sub(pattern, "", rest)
            wanted.append(len(rest) - len(less))
            rest = less
        assert r.k == [*wanted, len(rest)]
    plan = kinds._jdf.queryExecution().optimizedPlan().toString()
    assert "[a-z]+" not in plan  # blanks and lower-case letters go in one search
    common = F.array(F.lit("the"), F.lit("thé"))
    found = df.select(rules.common_counts(rules.words_of(F.col("t")), common).alias("c")).where("i = 4").first().c
    assert found[:2] == [3, 1] and found[-1] == 2 and len(found) == rules.COMMON + 1
    nothing = F.lit(None).cast("array<string>")
    assert df.select(rules.common_counts(rules.words_of(F.col("t")), nothing).alias("c")).where("i = 4").first().c[-1] == 6


def test_distance_is_that_of_jensen_and_shannon(spark):
    df = spark.createDataFrame([([1, 0], [0, 5]), ([3, 1], [3, 1]), ([1, 1], [1, 0]), ([0, 0], [1, 1])], "a array<long>, b array<long>")
    got = [r.d for r in df.select(rules.distance(F.col("a"), F.col("b")).alias("d")).collect()]
    m = [3 / 4, 1 / 4]
    between = (0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1]) + np.log2(1 / m[0])) / 2
    assert got[:3] == pytest.approx([1.0, 0.0, np.sqrt(between)]) and got[3] is None


def test_rules_keep_prose_and_drop_odd_writing(spark):
    rng = random.Random(8)
    common = "the of and to in is that for it with as was on be by at this are from or".split()
    words = common * 3 + ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(3000)]
    prose_ = [" ".join(rng.choices(words, k=rng.randint(80, 300))).capitalize() + "." for _ in range(80)]
    odd = [" ".join(w.upper() + "!!" for w in t.split()) for t in prose_[:2]]
    odd += [" ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in t.split()) for t in prose_[2:4]]
    short = " ".join(w.upper() for w in prose_[5].split()[:49])
    docs = frame(spark, prose_ + odd + [short]).withColumn("lang", F.lit("xx"))
    kept = {r.doc_id: (r.kept, r.base_failed, r.kind_distance) for r in rules.judge_quality(docs).collect()}
    assert all(kept[i][0] for i in range(80))
    assert all(kept[i][:2] == (False, False) for i in range(80, 84))
    assert kept[84] == (False, True, None)
    alone = frame(spark, odd[:1]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.kept for r in rules.judge_quality(alone).collect()] == [True]  # its language is too small to judge by


# --- mended --------------------------------------------------------------------------------------------------------


def test_letters_are_letters():
    assert not language.has_letter("½ ² 3 _") and language.has_letter("3 ß")


def test_near_duplicates_pass_clashing_columns_and_odd_blanks(spark):
    texts = [" ", " ", "\x85  ", " \n ", "", None, "a b c", "a b c"]
    docs = frame(spark, texts, ["_keep_id", "_keep_hash", "_keep_text", "row", "i", "h", *CLASH])
    kept = jaccard.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    assert kept.columns == docs.columns
