"""Queries over the order of training: files, workers, buffers, weighted draws, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.operators import packing, sampling, weights
from blendwise.plans import views
from blendwise.plans.corpus_queries import CHUNK_REPORT, PACKED, chunk_report, packed
from blendwise.plans.views import (
    BLOCK,
    CHUNK,
    CORPUS,
    DISTRIBUTION,
    r,
    rounded,
    sql_digest,
    sql_uniform,
    with_ctes,
)
from blendwise.session import durable

SEED = sampling.DATA_SEED
WORKERS, BUFFER, MICRO, ACCUMULATION = 3, 4, 8, 4

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


# --- files: every document stands for one file ------------------------------------------------------------------

PATH = "'/data/' || source || '-' || doc_id || '.jsonl'"
FILES = f"""
files AS (SELECT source AS domain, {PATH} AS path FROM documents),
shuffled AS (SELECT domain, path, row_number() OVER (PARTITION BY domain ORDER BY {sql_digest(SEED, 'path')}, path) - 1 AS pos
             FROM files)
"""


def files(spark, folder):
    docs = views.table(spark, folder, "documents").select(F.col("source").alias("domain"), "doc_id")
    number = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/data/"), "domain", F.lit("-"), number, F.lit(".jsonl"))
    return docs.select("domain", path.alias("path"))


@query("b1_shuffle_shards", with_ctes("SELECT domain, path, pos::BIGINT AS pos FROM shuffled", FILES))
def shuffle_shards(spark, folder):
    return sampling.shuffle_shards(files(spark, folder))


@query(
    "b2_assign_workers",
    with_ctes(
        f"""SELECT domain, path, pos::BIGINT AS pos, (pos % {WORKERS})::BIGINT AS worker, (pos // {WORKERS})::BIGINT AS worker_pos
            FROM shuffled JOIN (SELECT domain, count(*) AS n FROM files GROUP BY domain) USING (domain)
            WHERE pos < n // {WORKERS} * {WORKERS}""",
        FILES,
    ),
)
def assign_workers(spark, folder):
    return sampling.assign_workers(sampling.shuffle_shards(files(spark, folder)), WORKERS)


# The number of files that just more than half of the labelled domains reach.
SPARSE = """
found AS (SELECT source AS domain FROM labels JOIN documents USING (doc_id)),
counts AS (SELECT domain, count(*) AS n_files FROM found GROUP BY domain),
least AS (SELECT quantile_disc(n_files, 0.5) AS k FROM counts)
"""


def labelled_files(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", F.col("source").alias("domain"))
    labels = views.table(spark, folder, "labels").select("doc_id")
    found = labels.join(docs, "doc_id").select("domain")
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY count)")
    return found, int(found.groupBy("domain").count().agg(median).first()[0])


@query(
    "b4_drop_sparse_domains",
    with_ctes(
        f"""SELECT domain, {r('prior / sum(prior) OVER ()')} AS weight, n_files::BIGINT AS n_files
            FROM prior JOIN counts USING (domain), least WHERE n_files >= k""",
        CORPUS,
        DISTRIBUTION,
        SPARSE,
    ),
)
def drop_sparse_domains(spark, folder):
    found, least = labelled_files(spark, folder)
    prior = views.stored_distribution(spark, folder).select("domain", F.col("prior").alias("weight"))
    return sampling.drop_sparse_domains(prior, found, least).withColumn("weight", rounded("weight"))


@query(
    "b4_drop_sparse_groups",
    with_ctes(
        f"""SELECT grp, domain, {r('prior / sum(prior) OVER (PARTITION BY grp)')} AS weight, n_files::BIGINT AS n_files
            FROM grouped WHERE grp IN (SELECT grp FROM grouped, least GROUP BY grp HAVING bool_and(n_files >= k))""",
        CORPUS,
        DISTRIBUTION,
        SPARSE,
        """grouped AS (SELECT 'group' || (substr(domain, 4)::INTEGER % 12) AS grp, domain, prior, coalesce(n_files, 0) AS n_files
                       FROM prior LEFT JOIN counts USING (domain))""",
    ),
)
def drop_sparse_groups(spark, folder):
    """Validation groups of one or two domains."""
    found, least = labelled_files(spark, folder)
    number = F.pmod(F.substring("domain", 4, 9).cast("int"), F.lit(12)).cast("string")
    prior = views.stored_distribution(spark, folder).select(
        F.concat(F.lit("group"), number).alias("grp"), "domain", F.col("prior").alias("weight")
    )
    kept = sampling.drop_sparse_domains(prior, found, least, "grp")
    return kept.select("grp", "domain", rounded("weight").alias("weight"), "n_files")


# --- blocks ----------------------------------------------------------------------------------------------------

# Blocks from token counts alone.
BLOCK_LIST = f"""
block_list AS (
  SELECT domain, shard, chunk_no, unnest(range({CHUNK // BLOCK})) AS block_no FROM (
    SELECT domain, shard, unnest(range(n // {CHUNK})) AS chunk_no FROM (
      SELECT domain, shard, sum(len(tokens))::BIGINT AS n FROM corpus GROUP BY 1, 2))),
numbered AS (
  SELECT domain, shard, chunk_no, block_no,
         row_number() OVER (PARTITION BY domain ORDER BY {sql_digest(SEED, 'shard', 'chunk_no', 'block_no')}, shard, chunk_no, block_no) - 1
           AS block_seq
  FROM block_list),
wanted AS (SELECT domain, sqrt(prior) / sum(sqrt(prior)) OVER () AS weight FROM prior)
"""


def block_list(spark, folder):
    """Keys of all blocks, stored: several steps use them."""
    report = packing.packing_report(views.corpus_lengths(spark, folder), CHUNK).where("n_chunks > 0")
    chunks = report.select("domain", "shard", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(CHUNK // BLOCK - 1).cast("long"))
    return durable(chunks.withColumn("block_no", F.explode(numbers)))


def numbered_blocks(blocks):
    return sampling.shuffle_rows(blocks, ["shard", "chunk_no", "block_no"], SEED, "block_seq")


def wanted(spark, folder):
    prior = views.stored_distribution(spark, folder).select("domain", F.col("prior").alias("weight"))
    return weights.temper(prior, by=())


@query(
    "b3_shuffle_blocks",
    with_ctes(
        f"""SELECT domain, chunk_pos::BIGINT AS chunk_pos, block_no::BIGINT AS block_no, (chunk_pos // {BUFFER})::BIGINT AS buffer,
                   (row_number() OVER (PARTITION BY domain, chunk_pos // {BUFFER}
                      ORDER BY {sql_digest(SEED, 'domain', 'chunk_pos', 'block_no')}, chunk_pos, block_no) - 1)::BIGINT AS buffer_pos
            FROM (SELECT domain, block_no, dense_rank() OVER (PARTITION BY domain ORDER BY shard, chunk_no) - 1 AS chunk_pos
                  FROM block_list)""",
        CORPUS,
        DISTRIBUTION,
        BLOCK_LIST,
    ),
)
def shuffle_blocks(spark, folder):
    blocks = block_list(spark, folder)
    chunks = sampling.number_rows(
        blocks.select("domain", "shard", "chunk_no").distinct(), ["domain"], ["shard", "chunk_no"], "chunk_pos"
    )
    placed = blocks.join(chunks, ["domain", "shard", "chunk_no"]).select("domain", "chunk_pos", "block_no")
    return sampling.shuffle_blocks(placed, SEED, BUFFER)


# One round of positions per block of the corpus.
DRAWS = f"""
cumulated AS (SELECT domain, weight, hi / max(hi) OVER () AS hi, lag(hi, 1, 0e0) OVER (ORDER BY domain) / max(hi) OVER () AS lo FROM (
                SELECT domain, weight, sum(weight) OVER (ORDER BY domain ROWS UNBOUNDED PRECEDING) AS hi FROM wanted)),
positions AS (SELECT unnest(range((SELECT count(*) FROM block_list))) AS pos),
draws AS (SELECT pos, u, domain FROM (SELECT pos, {sql_uniform(sql_digest(SEED, "'draw'", 'pos'))} AS u FROM positions)
          JOIN cumulated ON u >= lo AND u < hi),
counted AS (SELECT pos, domain, row_number() OVER (PARTITION BY domain ORDER BY pos) - 1 AS nth FROM draws),
sizes AS (SELECT domain, count(*) AS available FROM numbered GROUP BY domain),
sampled AS (SELECT pos, domain, nth, nth // available AS epoch, nth % available AS block_seq, shard, chunk_no, block_no
            FROM (SELECT pos, domain, nth, available FROM counted JOIN sizes USING (domain)) AS d
            JOIN numbered AS b USING (domain) WHERE d.nth % d.available = b.block_seq)
"""
BASE = (CORPUS, DISTRIBUTION, BLOCK_LIST, DRAWS)


@query("j3_draw_domains", with_ctes(f"SELECT pos, domain, {r('u')} AS u FROM draws", *BASE))
def draw_domains(spark, folder):
    n = block_list(spark, folder).count()
    drawn = sampling.draw_domains(spark.range(n).withColumnRenamed("id", "pos"), wanted(spark, folder))
    return drawn.select("pos", "domain", rounded("u").alias("u"))


PLACE = """pos, domain, nth::BIGINT AS nth, epoch::BIGINT AS epoch, block_seq::BIGINT AS block_seq, shard,
           chunk_no::BIGINT AS chunk_no, block_no::BIGINT AS block_no"""
PLACED = ("pos", "domain", "nth", "epoch", "block_seq", "shard", "chunk_no", "block_no")


def draws(spark, folder, start: int = 0, level: int = 1):
    blocks = block_list(spark, folder)
    n = blocks.count()
    return sampling.mixture_sample(numbered_blocks(blocks), wanted(spark, folder), n - start, SEED, start, level)


@query("j4_draw_blocks", with_ctes(f"SELECT {PLACE} FROM sampled", *BASE))
def draw_blocks(spark, folder):
    """Where each drawn block lies."""
    return draws(spark, folder).select(*PLACED)


@query(
    "w1_mixture_sample",
    with_ctes(
        f"""SELECT pos, domain, epoch::BIGINT AS epoch, {CHUNK_REPORT}
            FROM sampled JOIN blocks USING (domain, shard, chunk_no, block_no)""",
        *BASE,
        PACKED,
    ),
)
def mixture_sample(spark, folder):
    """The training sequence with the tokens of each block."""
    blocks = packing.slice_blocks(packed(spark, folder), BLOCK)
    # The order is settled on narrow rows; tokens are fetched once at the end.
    return chunk_report(
        draws(spark, folder).join(blocks, ["domain", "shard", "chunk_no", "block_no"]), "pos", "domain", "epoch"
    )


@query(
    "w1_mixture_sample_resumed",
    with_ctes(f"SELECT {PLACE} FROM sampled WHERE pos >= 1000", *BASE),
)
def mixture_sample_resumed(spark, folder):
    """A run that goes on at position 1000."""
    return draws(spark, folder, 1000).select(*PLACED)


@query(
    "b5_group_sample",
    with_ctes(
        f"""SELECT pos, g.domain AS domain, (pos // {MICRO})::BIGINT AS batch, (nth // available)::BIGINT AS epoch,
                   shard::BIGINT AS shard, chunk_no::BIGINT AS chunk_no, block_no::BIGINT AS block_no
            FROM grouped AS g JOIN sizes ON sizes.domain = g.domain
                 JOIN numbered AS b ON b.domain = g.domain AND b.block_seq = nth % available""",
        *BASE,
        f"""grouped AS (SELECT p.pos AS pos, d.domain AS domain, row_number() OVER (PARTITION BY d.domain ORDER BY p.pos) - 1 AS nth
                        FROM positions AS p JOIN draws AS d ON d.pos = p.pos // {MICRO})""",
    ),
)
def group_sample(spark, folder):
    """One domain per micro-batch, whose positions take the next blocks of that domain."""
    batch = F.floor(F.col("pos") / MICRO).alias("batch")
    keys = [F.col(c).cast("long").alias(c) for c in ("epoch", "shard", "chunk_no", "block_no")]
    return draws(spark, folder, level=MICRO).select("pos", "domain", batch, *keys)


@query(
    "b6_number_batches",
    with_ctes(
        f"""SELECT pos, domain, (pos // {MICRO})::BIGINT AS iter, (pos % {MICRO})::BIGINT AS row_in_batch,
                   (pos // {MICRO} // {ACCUMULATION})::BIGINT AS step, (pos // {MICRO} + 1) % {ACCUMULATION} <> 0 AS is_accumulating
            FROM draws""",
        *BASE,
    ),
)
def number_batches(spark, folder):
    n = block_list(spark, folder).count()
    drawn = sampling.draw_domains(spark.range(n).withColumnRenamed("id", "pos"), wanted(spark, folder))
    return sampling.number_batches(drawn.drop("u"), MICRO, ACCUMULATION)


@query(
    "b7_realized_mixture",
    with_ctes(
        f"""SELECT domain, drawn::BIGINT AS drawn, epochs::BIGINT AS epochs, {r('weight / sum(weight) OVER ()')} AS target,
                   {r('drawn / sum(drawn) OVER ()')} AS share
            FROM (SELECT w.domain AS domain, any_value(weight) AS weight, count(pos) AS drawn, coalesce(max(epoch) + 1, 0) AS epochs
                  FROM wanted AS w LEFT JOIN sampled AS s ON w.domain = s.domain GROUP BY w.domain)""",
        *BASE,
    ),
)
def realized_mixture(spark, folder):
    found = sampling.realized_mixture(draws(spark, folder), wanted(spark, folder))
    return found.withColumn("target", rounded("target")).withColumn("share", rounded("share"))
