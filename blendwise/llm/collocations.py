"""Collocations of each language by prefix-free parsing.

Texts are cut into pieces at sentence and line marks, and pieces into chunks wherever a window of ``OVERLAP`` words
has a hash that is 0 modulo ``PERIOD``: the window ends one chunk and begins the next. Cuts depend on the content
alone, so repeated passages give the same chunks wherever they stand. Distinct chunks and how often each occurs form the
dictionary, and phrases are counted once per distinct chunk, weighted. Two neighbours share a window, so that every
phrase of up to ``OVERLAP + 1`` words lies whole in one of them; phrases within the shared window belong to the second.

A frequent phrase has frequent parts only. Words are counted first, then pairs of frequent words, then the longer
phrases all of whose pairs are frequent. What is frequent reaches the tasks as a bit table of fixed size
(``BITS``, 2 MB), which may let a rare phrase pass but never holds back a frequent one; counts themselves are exact.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.llm.common import forget, stored

LONGEST = 5
OVERLAP = LONGEST - 1
PERIOD = 8
BITS = 1 << 24
LEAST = 100
BEST = 2000
HELD = 200_000  # distinct chunks that a task adds up before it hands them on
#: Marks that end a piece become line feeds, tabs become blanks.
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def pieces_of(text: str) -> list[list[bytes]]:
    """The words of each piece that has any, in UTF-8, lower-cased in A-Z."""
    pieces = text.encode("utf-8", "surrogatepass").lower().translate(_MARKS).split(b"\n")
    return [words for words in map(bytes.split, pieces) if words]


def chunks_of(words: list[bytes]) -> Iterator[tuple[list[bytes], bool]]:
    """(chunk, whether the piece ends with it). A chunk shares its last ``OVERLAP`` words with the next one."""
    begin, last = 0, len(words) - LONGEST
    if last >= PERIOD // 2:
        codes = [zlib.crc32(w) for w in words]
        for i in range(1, last + 1):
            if (codes[i] * 3 + codes[i + 1] * 5 + codes[i + 2] * 7 + codes[i + 3] * 11 >> 7) % PERIOD == 0:
                yield words[begin : i + OVERLAP], False
                begin = i
    yield words[begin:], True


def chunk_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, n): distinct chunks of each language, words joined by a blank, and their parse frequency.

    A chunk that the piece goes on after has a line feed at its end. Tasks add up copies before they hand them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, counter in counters.items():
                chunks = pa.array(list(counter), pa.binary()).cast(pa.string())
                langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(chunks), np.int32)))
                counts = pa.array(list(counter.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([langs, chunks, counts], ["lang", "chunk", "n"])
            counters.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counter = counters.setdefault(lang.as_py(), Counter())
                for words in pieces_of(text.as_py()):
                    for chunk, ends in chunks_of(words):
                        counter[b" ".join(chunk) if ends else b" ".join(chunk) + b"\n"] += 1
                if sum(map(len, counters.values())) >= HELD:
                    yield from emptied()
        yield from emptied()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col))
    found = rows.mapInArrow(run, "lang string, chunk string, n long")
    return stored(found.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "chunks")


def _placed_words(chunks: DataFrame) -> DataFrame:
    """(lang, n, words, i, first): every word a chunk counts, with its place and all words of the chunk.

    Words of a window that two chunks share count in the second.
    """
    cut = F.col("chunk").endswith("\n")
    words = F.split(F.rtrim("chunk", F.lit("\n")), " ")
    rows = chunks.select("lang", "n", words.alias("words"), cut.alias("cut"))
    # The outer form: for the inner one Spark adds a size check that would split every chunk a second time.
    each = rows.select("lang", "n", "words", "cut", F.posexplode_outer("words").alias("i", "first"))
    return each.where(~F.col("cut") | (F.col("i") < F.size("words") - OVERLAP))


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def count_words(chunks: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""
    return _summed(_placed_words(chunks).select("lang", F.col("first").alias("phrase"), "n"))


def _key(*words: Column | str) -> Column:
    """A 64-bit hash of a language and some words."""
    return F.xxhash64("lang", *words)


def bit_table(keys: DataFrame) -> Column:
    """A scalar: ``BITS`` bits as an array of longs, set where a ``key`` falls.

    At most ``BITS / 64`` numbers pass the driver.
    """
    place = F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("place")
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    masks = keys.select(place).groupBy(F.shiftright("place", 6).alias("at"))
    rows = masks.agg(F.bit_or(bit).alias("mask")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[rows["at"].to_numpy()] = rows["mask"].to_numpy()
    lists = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))
    return keys.sparkSession.createDataFrame(pa.table({"bits": lists})).scalar()


def _known(bits: Column, key: Column) -> Column:
    place = key.bitwiseAND(F.lit(BITS - 1))
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _has(offset: int) -> Column:
    """Whether a word stands so far behind; as a comparison of numbers, from which no second split is inferred."""
    return F.coalesce(F.col("i") + offset < F.size("words"), F.lit(False))


def count_pairs(chunks: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of pairs of frequent words that are found at least ``least`` times.

    Most pairs are rare. They are counted by their hashes alone first, which move a fraction of the bytes and never
    count too low; only pairs whose hash is frequent are counted as they are written.
    """
    bits = bit_table(words.select(_key("phrase").alias("key")))
    second = F.get("words", F.col("i") + 1)
    rows = _placed_words(chunks).where(_has(1) & _known(bits, _key("first")) & _known(bits, _key(second)))
    hashed = rows.groupBy(_key("first", second).alias("key")).agg(F.sum("n").alias("f"))
    often = bit_table(hashed.where(F.col("f") >= least))
    rows = rows.where(_known(often, _key("first", second)))
    return _summed(rows.select("lang", F.concat_ws(" ", "first", second).alias("phrase"), "n")).where(F.col("f") >= least)


def count_longer(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of phrases of 3 to ``LONGEST`` words all of whose pairs are frequent."""
    two = F.split("phrase", " ")
    bits = bit_table(pairs.select(_key(two[0], two[1]).alias("key")))
    word = lambda j: F.get("words", F.col("i") + j)
    pair = lambda j: _has(j + 1) & _known(bits, _key(word(j), word(j + 1)))
    phrase = lambda size: F.concat_ws(" ", *[word(j) for j in range(size)])
    rows = _placed_words(chunks).where(pair(0) & pair(1))
    sizes = range(4, LONGEST + 1)
    reach = [F.when(reduce(Column.__and__, [pair(j) for j in range(2, size - 1)]), phrase(size)) for size in sizes]
    each = rows.select("lang", "n", F.explode(F.array(phrase(3), *reach)).alias("phrase"))
    return _summed(each.where("phrase IS NOT NULL").select("lang", "phrase", "n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to ``LONGEST`` words found at least ``least`` times, and
    (lang, n) with the number of words of each language."""
    chunks = chunk_dictionary(docs, text_col, lang_col)
    words = stored(count_words(chunks), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    known = words.where(F.col("f") >= least)
    pairs = stored(count_pairs(chunks, known, least), "pairs")
    longer = count_longer(chunks, pairs).where(F.col("f") >= least)
    every = known.unionByName(pairs).unionByName(longer)
    phrases = stored(every.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "phrases")
    forget(chunks, words, pairs)
    return phrases, totals


def _words(phrase: Column, begin: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin, count), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, best: int = BEST, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``LONGEST`` words found a >= ``least`` times. Cutting one in two parts found l and r
    times scores floor(1000 a n / (l r)), n being the language's words; the least cut counts, ties to the
    shortest first part. A candidate that a longer one contains without being rarer is dropped. Ranks go by score
    and a, both descending, then by the bytes of the phrase. Sums and products are exact up to 38 digits.

    NULL texts have no words and a NULL language is ``und``; repeated rows count each time; texts of any length are
    read whole; an empty table gives an empty result. Only the two named columns are read.
    """
    phrases, totals = frequent_phrases(docs, least, text_col, lang_col)
    long_ones = phrases.where("size >= 2")
    cuts = long_ones.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", _words(F.col("phrase"), 1, F.col("cut")))
    cuts = cuts.withColumn("rest", _words(F.col("phrase"), F.col("cut") + 1, F.col("size")))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(1000 * ({wide('f')} * {wide('n')}) as decimal(38,0)) div ({wide('l')} * {wide('r')})")
    cut = F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("cut")
    scored = scored.groupBy("lang", "phrase", "f", "n").agg(cut)
    # A container of the same count has one of one word more among its own parts, so two parts of each suffice.
    inner = long_ones.where("size >= 3").select(
        "lang",
        F.explode(F.array(_words(F.col("phrase"), 1, F.col("size") - 1), _words(F.col("phrase"), 2, F.col("size")))).alias("phrase"),
        F.col("f").alias("around"),
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where("around IS NULL OR around < f")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    # The rank limit is applied in every task before its rows meet.
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= best)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
