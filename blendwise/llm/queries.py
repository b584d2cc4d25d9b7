"""The operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm import (
    codes,
    collocations,
    decontamination,
    jaccard,
    language,
    neighbours,
    packing,
    pii,
    quality,
    rules,
    sharding,
    toxicity,
    urls,
)
from blendwise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLES["op1_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT size FROM bw),
ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, s, ds.size, item_id FROM ds JOIN bw
  ON ds.size = bw.size AND array_to_string(w[s:s + ds.size - 1], ' ') = g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query
def op2_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), with_ids=False)


@query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLES["op4_nearest"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def held_out(folds: int, remainder: int):
    """Documents that no model may learn from, by the checksum of their id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == remainder


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out(5, 0)))
    return language.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


@query
def op7_shard_ring(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def _judged(scores: DataFrame, held) -> DataFrame:
    return scores.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame | None = None):
    """Fitted on the labelled documents outside the held-out part."""
    docs = table(spark, folder, "documents") if docs is None else docs
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held_out(5, 0))
    return toxicity.train(docs.select("doc_id", "text").where(~held_out(5, 0)), labels)


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, toxicity_model(spark, folder)), held_out(5, 0))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = quality.train(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1)))
    return _judged(quality.score(docs, model), held_out(3, 1))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """The counts are of the base spans, like the digest; ``n_added`` counts what the transducer found besides."""
    found = pii.find_personal_data(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op11_collocations"] = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, w FROM (
    SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS s FROM documents)) WHERE len(w) > 0),
g AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, range(1, 6) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, n.n, cut,
    (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM s),
kept AS (
  SELECT * FROM best WHERE pick = 1 AND NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = best.lang AND f.k > best.k AND f.f >= best.a
      AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


@query
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress_vectors(table(spark, folder, "embeddings"))


def _code_sql() -> str:
    """Each round as two tables: the nearest entries, and the codebook they make."""
    size = codes.PARTS

    def near(book: str) -> str:
        return f"""
SELECT rid, part, entry, d FROM (
  SELECT x.rid, x.part, b.entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d,
    row_number() OVER (PARTITION BY x.rid, x.part ORDER BY d, b.entry) AS pick
  FROM x JOIN {book} AS b ON b.part = x.part) WHERE pick = 1"""

    rounds = "".join(
        f""",
a{i} AS MATERIALIZED ({near(f"b{i}")}),
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} AS b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (
        SELECT part, entry, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM x JOIN a{i} USING (rid, part))
      GROUP BY part, entry, i) GROUP BY part, entry) AS m ON m.part = b.part AND m.entry = b.entry)"""
        for i in range(codes.ROUNDS)
    )
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // {size}) + 1:(part + 1) * (len(v) // {size})] AS v FROM k, range({size}) AS parts(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM x WHERE rid <= {codes.ENTRIES}){rounds},
z AS MATERIALIZED ({near(f"b{codes.ROUNDS}")}),
e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM k JOIN e USING (rid), h"""


ORACLES["op12_vector_codes"] = _code_sql()


@query
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.judge_quality(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rules_sql() -> str:
    gone = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"  # noqa: E731
    taken = {name: gone(pattern) for name, pattern in rules.KINDS}
    taken["mark"] += " - lower_ - upper_ - digit_ - stop_ - symbol_"
    kinds = ", ".join(f"{sql} AS {name}_" for name, sql in taken.items())
    names = [f"{name}_" for name in taken]
    far = lambda a, b: f"""sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i:
      CASE WHEN {a}[i] > 0 THEN {a}[i] / list_sum({a}) * log2(2 * ({a}[i] / list_sum({a})) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END / 2
      + CASE WHEN {b}[i] > 0 THEN {b}[i] / list_sum({b}) * log2(2 * ({b}[i] / list_sum({b})) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END / 2)), 0))"""  # noqa: E731
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, 'und') AS lang,
    string_split_regex(t, '[ 	-]+') AS parts, list_filter(parts, lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines, {kinds}
  FROM documents),
k AS MATERIALIZED (SELECT *, [{', '.join(names)}, length(t) - {' - '.join(names)}] AS kinds FROM d),
win AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (
  SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM win JOIN (
    SELECT rid, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (rid, g)) GROUP BY rid),
big AS (SELECT * FROM k WHERE len(parts) >= {rules.GUARD_WORDS + 2}),
rk AS (SELECT lang, list(s ORDER BY i) AS ref_kinds FROM (
  SELECT lang, i, sum(c) AS s FROM (SELECT lang, unnest(kinds) AS c, unnest(range(len(kinds))) AS i FROM big) GROUP BY ALL) GROUP BY lang),
wc AS (SELECT lang, CASE WHEN length(x) <= {rules.LONGEST_COMMON} THEN x END AS x, count(*) AS n FROM (
  SELECT lang, unnest(w) AS x FROM big) GROUP BY ALL),
top AS (SELECT lang, list(x ORDER BY place) AS xs, list(n ORDER BY place) AS ns FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS place FROM wc WHERE x IS NOT NULL)
  WHERE place <= {rules.COMMON} GROUP BY lang),
tot AS (SELECT lang, sum(n) AS total FROM wc GROUP BY lang),
r AS (SELECT tot.lang, ref_kinds, coalesce(xs, []) AS xs, coalesce(ns, []) AS ns, total
  FROM tot JOIN rk USING (lang) LEFT JOIN top USING (lang)),
own AS (SELECT rid, list(n ORDER BY place) AS counts FROM (
  SELECT k.rid, place, count(y.x) AS n FROM k JOIN r USING (lang), unnest(range(1, len(xs) + 1)) AS u(place)
  LEFT JOIN (SELECT rid, unnest(w) AS x FROM k) AS y ON y.rid = k.rid AND y.x = r.xs[place] GROUP BY ALL) GROUP BY rid),
j AS (
  SELECT k.doc_id, len(w) AS n_words, length(t) - blank_ - line_ AS word_chars, symbol_ AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, kinds, ref_kinds, total,
    list_append(counts, len(w) - list_sum(counts)) AS own, list_append(ns, total - list_sum(ns)) AS ref_counts
  FROM k LEFT JOIN cov USING (rid) LEFT JOIN r USING (lang) LEFT JOIN own USING (rid)),
m AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed,
  CASE WHEN n_words >= {rules.GUARD_WORDS} AND total >= {rules.GUARD_REFERENCE} THEN
    {far("kinds", "ref_kinds")} > {rules.CLASS_LIMIT} OR {far("own", "ref_counts")} > {rules.WORD_LIMIT} ELSE false END AS far
  FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(far, false) AS kept
FROM m"""


ORACLES["op13_quality_rules"] = _rules_sql()
