"""Benchmark decontamination by winnowing, in DataFrame functions only.

A fingerprint is the smallest hash of ``gram`` consecutive words within a sliding window. With
``span - gram + 1`` grams per window every run of ``span`` equal words holds at least one common fingerprint on both
sides, so joining fingerprints misses nothing. Each join hit carries the few words around it and is extended
against the item's words, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import let, lower_ascii
from blendwise.session import durable

SPAN = 13
GRAM = 5
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
PLACE = "struct<hash:bigint,low:int,place:int,around:array<string>>"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, as written; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), "")


def folded(word: Column) -> Column:
    """A-Z lower-cased. The quick function also changes other letters, so only plain ASCII words may take it."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def _upto(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, n: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """Array of (hash, place): the smallest gram hash of each window of ``span`` words, the leftmost of equal ones.

    Below ``span`` words there is none. The low four bits of a hash give way to its offset within the window, so that
    the minimum carries its place along and equal windows choose the same gram wherever they stand. Places never
    go back from window to window, so each is kept once.
    """
    per_window = span - gram + 1
    if per_window > 16:
        raise ValueError("at most 16 grams per window")
    hashes = F.transform(words, lambda w: F.xxhash64(folded(w)))
    grams = let(
        hashes,
        lambda h: F.transform(
            _upto(n - gram),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(gram)]).bitwiseAND(F.lit(~15)),
        ),
    )
    smallest = let(
        grams,
        lambda g: F.transform(
            _upto(n - span), lambda i: F.least(*[F.get(g, i + j).bitwiseOR(F.lit(j)) for j in range(per_window)])
        )
        if per_window > 1
        else g,
    )
    chosen = let(
        smallest,
        lambda m: F.transform(
            m,
            lambda v, i: F.struct(
                F.shiftright(v, 4).alias("hash"), (i + v.bitwiseAND(F.lit(15)).cast("int")).alias("place")
            ),
        ),
    )
    return let(
        chosen,
        lambda c: F.filter(c, lambda f, i: (i == 0) | (f["place"] != F.get(c, i - 1)["place"])),
    )


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a table that is stored and counted to be small; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hits(texts: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """(_id, _hash, n, item_id, start, length): equal windows of ``span`` words in texts and in items that long.

    Each text row also gives one row with NULL item_id, so that texts without hits are not lost.
    """
    reach = span - gram  # words before a fingerprint that a window around it can begin with
    marks = items.where(F.col("n") >= span).select(
        "item_id", "words", F.explode(fingerprints(F.col("words"), F.col("n"), span, gram)).alias("f")
    )
    low = F.greatest(F.col("f.place") - reach, F.lit(0))
    marks = durable(
        marks.select(
            "item_id",
            F.col("f.hash").alias("hash"),
            (F.col("f.place") - low).alias("item_before"),
            F.transform(F.slice("words", low + 1, span + reach), folded).alias("item_words"),
        ).distinct()
    )
    places = F.transform(
        fingerprints(F.col("words"), F.col("n"), span, gram),
        lambda f: F.struct(
            f["hash"].alias("hash"),
            F.greatest(f["place"] - reach, F.lit(0)).alias("low"),
            f["place"].alias("place"),
            F.slice(F.col("words"), F.greatest(f["place"] - reach, F.lit(0)) + 1, span + reach).alias("around"),
        ),
    )
    # The row itself: no hash, so it joins nothing.
    found = texts.select("_id", "_hash", "n", F.explode(F.concat(F.array(F.lit(None).cast(PLACE)), places)).alias("d"))
    found = found.select("_id", "_hash", "n", "d.hash", "d.low", "d.place", "d.around")
    found = found.join(_bounded(marks), "hash", "left").where("hash IS NULL OR item_id IS NOT NULL")
    found = found.withColumn("around", F.transform("around", folded))
    before = F.col("place") - F.col("low")
    # Windows begin 0 to ``reach`` words before the fingerprint, as far as both sides have the words.
    back = F.filter(
        F.sequence(F.lit(0), F.least(before, F.col("item_before"))),
        lambda b: (F.size(F.slice("around", before - b + 1, span)) == span)
        & (F.slice("around", before - b + 1, span) == F.slice("item_words", F.col("item_before") - b + 1, span)),
    )
    back = F.when(F.col("item_id").isNull(), F.array(F.lit(0))).otherwise(back)
    found = found.select("_id", "_hash", "n", "item_id", "place", F.explode(back).alias("b"))
    return found.select("_id", "_hash", "n", "item_id", (F.col("place") - F.col("b")).alias("start"), F.lit(span).alias("length"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, _hash, n_words, hits (start, length), items (ids as sorted strings), n_hit.

    Windows are ``span`` consecutive item words; an item with fewer is one window, matched by the same join with
    its own length. Rows of the documents are told apart by id and text hash: repeated rows get equal results,
    rows without id are judged like others. NULL and empty texts have no words. Items without id or words match
    nothing; items repeated under one id count once. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("words")
    )
    items = durable(items.withColumn("n", F.size("words")).where("n > 0"))
    hits = _hits(rows, items, span, gram)
    # At most span - 1 lengths, whatever the input.
    for length in sorted(r.n for r in items.where(F.col("n") < span).select("n").distinct().collect()):
        short = _hits(rows, items.where(F.col("n") == length), length, min(gram, length))
        hits = hits.union(short.where("item_id IS NOT NULL"))
    own = F.col("item_id").isNull()
    hits = hits.groupBy("_id", "_hash", "n").agg(
        F.sum(own.cast("int")).alias("copies"),
        F.collect_set(F.when(~own, F.struct("start", "length"))).alias("hits"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    )
    return hits.select(
        F.col("_id").alias("doc_id"),
        "_hash",
        F.col("n").cast("long").alias("n_words"),
        "hits",
        "items",
        F.size(covered).cast("long").alias("n_hit"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns; see ``contamination`` for odd rows."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col)
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("_hash").alias("_bad_hash")).distinct()
    hashed = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (hashed == bad["_bad_hash"]), "left_anti")
