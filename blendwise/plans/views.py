"""How the given tables stand for a corpus, mixtures, losses and run histories.

Every view exists twice: as DataFrames, and as SQL for the comparison with another engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.functions.draws import ATTEMPTS
from blendwise.functions.text import EOS
from blendwise.operators.ordering import id_bucket, join_same, number_rows
from blendwise.operators.tokens import count_tokens, tokenize
from blendwise.operators.weights import normalize_weights, token_distribution
from blendwise.session import durable

DIGITS = 6
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BRANDS = tuple(f"Brand#{number}" for number in range(1, 26))
CHUNK, BLOCK = 512, 65


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column: Column | str) -> Column:
    """Six decimals, halves away from zero on the binary value as in SQL, and no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    factor = F.lit(10.0**DIGITS)
    return F.signum(column) * F.floor(F.abs(column) * factor + 0.5) / factor + F.lit(0.0)


def r(expression: str) -> str:
    return f"(round(({expression})::DOUBLE, {DIGITS}) + 0e0)"


def with_ctes(select: str, *parts: str, recursive: bool = False) -> str:
    """One statement from common table expressions and a final select."""
    body = ",\n".join(part.strip() for part in parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select.strip()}"


# --- corpus: documents ---------------------------------------------------------------------------------------


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.col("source").alias("domain"), F.pmod("doc_id", F.lit(4)).alias("shard"), "text")


def corpus_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize(corpus(spark, folder)).drop("text")


def corpus_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(corpus(spark, folder)).drop("text")


def distribution(spark: SparkSession, folder: str) -> DataFrame:
    return token_distribution(corpus_lengths(spark, folder))


def stored_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """The distribution for queries that use it several times: one row per domain, counted once."""
    return durable(distribution(spark, folder))


def doc_bucket() -> Column:
    return id_bucket(F.col("doc_id"))


CORPUS = f"""
corpus AS (
  SELECT doc_id, source AS domain, doc_id % 4 AS shard, text,
         list_append(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0B]+'), '{EOS}') AS tokens
  FROM documents)
"""
DISTRIBUTION = """
dist AS (SELECT domain, count(*)::BIGINT AS n_docs, sum(len(tokens))::BIGINT AS n_tokens FROM corpus GROUP BY domain),
prior AS (SELECT domain, n_docs, n_tokens, n_tokens::DOUBLE / (sum(n_tokens) OVER ())::DOUBLE AS prior FROM dist)
"""
# --- mixtures and losses: lineitem and part ------------------------------------------------------------------


def mixture_units(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity by (index = supplier, domain = brand)."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("l_suppkey").alias("index"), F.col("p_brand").alias("domain")).agg(
        F.sum("l_quantity").alias("weight")
    )


def mixtures(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_weights(mixture_units(spark, folder))


def brand_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each brand in all quantities."""
    totals = mixture_units(spark, folder).groupBy("domain").agg(F.sum("weight").alias("weight"))
    return normalize_weights(totals, ()).select("domain", F.col("weight").alias("prior"))


def losses(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("index"))
    return items.agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_loss"),
        F.avg("l_discount").alias("discount_loss"),
    )


MIXTURE = """
units AS (SELECT l_suppkey AS "index", p_brand AS domain, sum(l_quantity) AS units
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
mix AS (SELECT "index", domain, units / sum(units) OVER (PARTITION BY "index") AS weight FROM units)
"""
BRAND_PRIOR = """
brand_units AS (SELECT domain, sum(units) AS units FROM units GROUP BY domain),
prior AS (SELECT domain, units / sum(units) OVER () AS prior FROM brand_units)
"""
LOSSES = """
losses AS (SELECT l_suppkey AS "index", avg(l_extendedprice / l_quantity) AS price_loss,
                  avg(l_discount) AS discount_loss
           FROM lineitem GROUP BY 1)
"""
# --- run histories: events -----------------------------------------------------------------------------------


def ranked_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their place ``seq`` in the run (user), from 0. Ranked rows are stored, so only used columns go in."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("run"), "event_id", "ts", "event_type", "value"
    )
    return number_rows(events, ["run"], ["ts", "event_id"], "seq")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse history: one metric column per event type, ten rows per step."""
    columns = [F.when(F.col("event_type") == kind, F.col("value")).alias(kind) for kind in EVENT_TYPES]
    return ranked_events(spark, folder).select("run", "seq", F.floor(F.col("seq") / 10).alias("step"), *columns)


def monitor_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per training iteration."""
    ranked = ranked_events(spark, folder)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ranked = ranked.withColumn("_at", micros)
    starts = ranked.groupBy("run").agg(F.min("_at").alias("_start"))
    rows = join_same(ranked, starts, ["run"])
    iteration = F.col("seq")
    return rows.select(
        "run",
        iteration.alias("iter"),
        ((F.col("_at") - F.col("_start")) / 1e6).alias("elapsed"),
        ((iteration + 1) * 4).alias("samples"),
        ((iteration + 1) * 2048).alias("lengths"),
        (F.pmod("run", F.lit(4)) + 1).alias("world_size"),
        F.log(1 + F.col("value")).alias("loss"),
        (1 + F.col("value")).alias("flops"),
        (F.lit(500.0) + F.col("run")).alias("peak_flops"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("eval_seconds"),
    )


RANKED = """
ranked AS (SELECT user_id AS run, event_id, ts, event_type, value, props,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)
"""
HISTORY = (
    RANKED
    + ", history AS (SELECT run, seq, seq // 10 AS step, "
    + ", ".join(f"CASE WHEN event_type = '{kind}' THEN value END AS {kind}" for kind in EVENT_TYPES)
    + " FROM ranked)"
)
MONITOR = (
    RANKED
    + """, monitor AS (
  SELECT run, seq AS iter, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run))::DOUBLE / 1e6 AS elapsed,
         (seq + 1) * 4 AS samples, (seq + 1) * 2048 AS lengths, run % 4 + 1 AS world_size, ln(1e0 + value) AS loss,
         1e0 + value AS flops, 5e2 + run AS peak_flops,
         CASE WHEN event_type = 'error' THEN value END AS eval_seconds
  FROM ranked)
"""
)
# --- seeded draws in SQL -------------------------------------------------------------------------------------


def sql_digest(*parts) -> str:
    return f"md5(concat_ws(':', {', '.join(str(part) for part in parts)}))"


def sql_uniform(hashed: str, word: int = 0) -> str:
    return f"((('0x' || substr({hashed}, {8 * word + 1}, 8))::UBIGINT::DOUBLE + 5e-1) / 4294967296e0)"


def sql_dirichlet(samples: str, prior: str, seed: int) -> str:
    """CTE ``simplex`` (sample_id, domain, weight) from CTEs with (sample_id, strength) and (domain, prior)."""
    d = f"(a + {1 - 1 / 3!r}::DOUBLE)"
    x = f"(sqrt(-2e0 * ln({sql_uniform('h', 0)})) * cos({2 * math.pi!r}::DOUBLE * {sql_uniform('h', 1)}))"
    v = f"pow(1e0 + {x} / sqrt(9e0 * {d}), 3e0)"
    accept = f"(v > 0 AND ln({sql_uniform('h', 2)}) < 5e-1 * x * x + {d} - {d} * v + {d} * ln(CASE WHEN v > 0 THEN v END))"

    def step(number: str, source: str) -> str:
        inner = f"SELECT sample_id, domain, a, {number} AS k, {sql_digest(seed, 'sample_id', 'domain', number)} AS h {source}"
        with_x = f"SELECT *, {x} AS x FROM ({inner})"
        with_v = f"SELECT *, {v.replace(x, 'x')} AS v FROM ({with_x})"
        return f"SELECT sample_id, domain, a, k, h, x, v, coalesce({accept}, false) AS ok FROM ({with_v})"

    first = step("0", f"FROM (SELECT sample_id, domain, prior * strength AS a FROM {samples}, {prior})")
    later = step("(k + 1)", f"FROM attempts WHERE NOT ok AND k < {ATTEMPTS - 1}")
    return f"""
attempts AS ({first} UNION ALL {later}),
logs AS (SELECT sample_id, domain, ln({d}) + ln(v) + ln({sql_uniform('h', 3)}) / a AS logg FROM attempts WHERE ok),
parts AS (SELECT sample_id, domain, exp(logg - max(logg) OVER (PARTITION BY sample_id)) AS part FROM logs),
simplex AS (SELECT sample_id, domain, round(part / sum(part) OVER (PARTITION BY sample_id), 12) AS weight FROM parts)
"""
