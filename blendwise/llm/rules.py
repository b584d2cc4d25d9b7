"""Quality rules: fixed limits on a text, and how far its histograms lie from those of its language.

Each language has two reference histograms, counted over all documents with more than ``GUARD_WORDS`` words: kinds of
characters, and its ``COMMON`` most frequent words, as written, besides all others. A document is compared with the references of its
own language by the Jensen-Shannon distance (base 2, from 0 to 1). Short texts have uneven histograms by chance, so a
distance counts only from ``GUARD_WORDS`` words in the document and ``GUARD_REFERENCE`` words in the reference on.

Everything is column expressions: one pass for the references, one for the verdicts, no shuffle of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.llm.common import let, stored

WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
COMMON = 20
LONGEST_COMMON = 32  # characters, which bounds a reference
GUARD_WORDS = 50
GUARD_REFERENCE = 1000
CLASS_LIMIT = 0.3
WORD_LIMIT = 0.45
SMALL = 4096  # languages up to which the references are broadcast: at most 32 MB

BLANK = r"[\x20\x09-\x0D]+"
#: Kinds of characters, each without those of the kinds before it; what is left counts as ``other``.
KINDS = (
    ("lower", "[a-z]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("blank", r"[\x20\x09]+"),
    ("line", r"[\x0A-\x0D]+"),
    ("stop", "[.,;:!?]+"),
    ("symbol", "[#*$%&|<>]+"),
    ("mark", r"[\x21-\x7E]+"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def kinds_of(text: Column) -> Column:
    """array<long> of the number of characters of each kind, ``other`` last.

    Blanks are counted by plain replacement. Runs of lower-case letters and blanks, most of a text, then go at one
    stroke, and only what they leave is taken apart kind by kind.
    """
    small = "".join(pattern[1:-2] for name, pattern in KINDS if name in ("lower", "blank"))

    def first(rest: Column) -> Column:
        unspaced = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))
        blanks = (F.length(text) - F.length(unspaced)).cast("long")
        lower = lambda b: (F.length(text) - F.length(rest)).cast("long") - b
        return let(blanks, lambda b: count(rest, KINDS[1:], [lower(b)], b))

    def count(rest: Column, left: tuple, found: list[Column], blanks: Column) -> Column:
        if not left:
            return F.array(*found, F.length(rest).cast("long"))
        if left[0][0] == "blank":
            return count(rest, left[1:], [*found, blanks], blanks)
        return let(
            F.regexp_replace(rest, left[0][1], ""),
            lambda less: count(less, left[1:], [*found, (F.length(rest) - F.length(less)).cast("long")], blanks),
        )

    return let(F.regexp_replace(text, f"[{small}]+", ""), first)


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of ``WINDOW`` words found twice or more in the array.

    Windows are compared by 64-bit hashes. Sorting them puts equal ones side by side, whatever their number.
    """
    span = F.size(words) - WINDOW
    hashed = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s,
                lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False))
                | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            ),
        )
        places = F.sort_array(F.transform(twice, lambda e: e["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")
        )
        return F.aggregate(places, start, step, lambda a: a["n"])

    none = F.lit(0).cast("long")
    hashes = F.when(span >= 1, F.transform(F.sequence(F.lit(0), span), hashed)).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of counts of the same length); NULL if one has no counts."""

    def shares(counts: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
        each = lambda c: let(total(c), lambda n: F.transform(c, lambda x: x / F.nullif(n, F.lit(0).cast("long"))))
        return let(counts, each)

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.when(p.isNotNull(), F.lit(0.0)))

    both = F.zip_with(shares(a), shares(b), lambda p, q: (part(p, q) + part(q, p)) / 2)
    divergence = F.aggregate(both, F.lit(0.0), lambda x, y: x + y)
    return let(divergence, lambda d: F.sqrt(F.when(d < 0, 0.0).otherwise(d)))  # below 0 by rounding only


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col), F.lit("und"))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ref_lang, ref_kinds, ref_words, ref_counts): the histograms of each language, NULL counting as ``und``.

    ``ref_words`` has the most frequent words, ties by bytes; ``ref_counts`` theirs and that of all other words.
    Words longer than ``LONGEST_COMMON`` are among the others. Counts combine before they are shuffled.
    """
    rows = docs.select(_language(lang_col).alias("ref_lang"), _text(text_col).alias("t"))
    enough = F.size(F.split("t", BLANK)) >= GUARD_WORDS + 2  # a blank at either end makes an empty word
    kinds = rows.where(enough).select("ref_lang", kinds_of(F.col("t")).alias("k"))
    kinds = kinds.groupBy("ref_lang").agg(
        F.array(*[F.sum(F.get("k", F.lit(i))) for i in range(len(KINDS) + 1)]).alias("ref_kinds")
    )
    found = let(F.split("t", BLANK), lambda w: F.when(F.size(w) >= GUARD_WORDS + 2, F.array_remove(w, "")))
    # The outer form: for the inner one Spark adds a size check that would split every text a second time.
    each = rows.select("ref_lang", F.explode_outer(found).alias("w")).where("w IS NOT NULL")
    word = F.when(F.length("w") <= LONGEST_COMMON, F.col("w"))
    counts = stored(each.groupBy("ref_lang", word.alias("w")).agg(F.count(F.lit(1)).alias("n")), "words")
    totals = counts.groupBy("ref_lang").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w"))
    top = counts.where("w IS NOT NULL").withColumn("place", place).where(F.col("place") <= COMMON)  # few rows a task
    top = top.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("place", "w", "n"))).alias("top"))
    known = F.coalesce("top", F.array().cast("array<struct<place:int,w:string,n:bigint>>"))
    others = F.col("total") - F.aggregate(known, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    padded = F.concat(
        F.transform(known, lambda e: e["n"]), F.array_repeat(F.lit(0).cast("long"), F.lit(COMMON) - F.size(known))
    )
    return kinds.join(totals, "ref_lang").join(top, "ref_lang", "left").select(
        "ref_lang", "ref_kinds", F.transform(known, lambda e: e["w"]).alias("ref_words"),
        F.concat(padded, F.array(others)).alias("ref_counts"),
    )


def common_counts(words: Column, common: Column) -> Column:
    """How often each common word stands among the words, and last how often any other does.

    Words with more bytes than the longest common one are not looked up.
    """
    longest = F.array_max(F.transform(common, lambda c: F.octet_length(c)))
    places = let(
        longest,
        lambda most: F.filter(
            F.transform(F.filter(words, lambda w: F.octet_length(w) <= most), lambda w: F.array_position(common, w)),
            lambda i: i > 0,
        ),
    )
    return let(
        places,
        lambda found: F.array(
            *[(F.size(found) - F.size(F.array_remove(found, F.lit(i + 1).cast("long")))).cast("long") for i in range(COMMON)],
            (F.size(words) - F.size(found)).cast("long"),
        ),
    )


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kind_distance, word_distance, kept.

    Words are runs without ASCII white space. The base rules drop texts of under ``LEAST_WORDS`` words, and those
    where more than half of the words stand in repeated windows; others are dropped if a distance exceeds its limit. A
    distance is NULL, and drops nothing, where a guard holds it back or the language has no reference. NULL and
    empty texts have no words and fail the base rules; rows without a language belong to ``und``; repeated rows are
    judged alike; an empty table gives an empty result. Only the three named columns are read.
    """
    refs = stored(references(docs, text_col, lang_col) if refs is None else refs, "references")
    small = refs.count() <= SMALL
    rows = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("t"), _language(lang_col).alias("ref_lang"))
    rows = rows.join(F.broadcast(refs) if small else refs, "ref_lang", "left")
    own = let(
        words_of(F.col("t")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            common_counts(w, F.col("ref_words")).alias("common"),
        ),
    )
    rows = rows.select("*", own.alias("own"), kinds_of(F.col("t")).alias("kinds"), repeated_lines(F.col("t")).alias("n_dup_lines"))
    n, repeats = F.col("own.n_words"), F.col("own.n_repeat_words")
    kind = {name: F.get("kinds", F.lit(i)) for i, (name, _) in enumerate(KINDS)}
    known = F.aggregate("ref_counts", F.lit(0).cast("long"), lambda a, c: a + c)
    guarded = (n >= GUARD_WORDS) & (known >= GUARD_REFERENCE)
    rows = rows.select(
        "doc_id",
        n.alias("n_words"),
        (F.length("t") - kind["blank"] - kind["line"]).cast("long").alias("word_chars"),
        kind["symbol"].alias("n_symbols"),
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)).alias("base_failed"),
        F.when(guarded, distance(F.col("kinds"), F.col("ref_kinds"))).alias("kind_distance"),
        F.when(guarded, distance(F.col("own.common"), F.col("ref_counts"))).alias("word_distance"),
    )
    far = (F.col("kind_distance") > CLASS_LIMIT) | (F.col("word_distance") > WORD_LIMIT)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
