"""Queries over the corpus: tokens, vocabulary, packing, chunk storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendwise.functions.text import BOS, SPECIALS, id_width
from blendwise.operators import packing, tokens, weights
from blendwise.plans import views
from blendwise.plans.views import BLOCK, CHUNK, CORPUS, DISTRIBUTION, r, rounded, with_ctes
from blendwise.session import scratch
from blendwise.sources import corpus as corpus_source
from blendwise.sources import tables
from blendwise.sources.files import rename_parts

VOCABULARY = 65_500
MAX_LENGTH = 64
NAME = "'train_demo_' || source || '-' || (doc_id % 4) || '_0_0000000000.bin'"

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def text_md5(column: str) -> Column:
    return F.md5(F.array_join(F.col(column).cast("array<string>"), " "))


def with_files(spark, folder: str) -> DataFrame:
    """Documents with the name of the chunk file they would go to."""
    docs = views.table(spark, folder, "documents").select("doc_id", "source")
    shard = F.pmod("doc_id", F.lit(4)).cast("string")
    return docs.withColumn(
        "path", F.concat(F.lit("/data/train_demo_"), "source", F.lit("-"), shard, F.lit("_0_0000000000.bin"))
    )


@query(
    "s4_read_corpus",
    with_ctes("SELECT domain, n_docs, n_tokens FROM dist", CORPUS, DISTRIBUTION),
)
def read_corpus(spark, folder):
    """Documents as JSON lines in ``train/<domain>-<n>.jsonl``, read back and counted."""
    root = scratch(spark, "corpus")
    docs = views.corpus(spark, folder).select("domain", "text")
    docs.hint("rebalance", "domain").write.partitionBy("domain").json(f"{root}/staged")
    rename_parts(spark, f"{root}/staged", f"{root}/train", lambda domain, part: f"{domain}-{part}.jsonl")
    found = tokens.count_tokens(corpus_source.read_corpus(spark, root, "train"))
    return weights.token_distribution(found).select("domain", "n_docs", "n_tokens")


@query(
    "p1_with_domain",
    """SELECT 'train_demo_' || source AS domain, (doc_id % 4)::INTEGER AS shard, count(*)::BIGINT AS n
       FROM documents GROUP BY 1, 2""",
)
def with_domain(spark, folder):
    named = tokens.with_domain(with_files(spark, folder))
    return named.groupBy("domain", "shard").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p2_match_domain",
    f"""WITH names AS (SELECT {NAME} AS name FROM documents),
        keys AS (SELECT DISTINCT 'train_demo_' || source AS key FROM documents)
        SELECT key, count(*)::BIGINT AS n_docs, count(DISTINCT name)::BIGINT AS n_files
        FROM names JOIN keys ON starts_with(name, key || '-') GROUP BY key""",
)
def match_domain(spark, folder):
    files = with_files(spark, folder)
    named = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    keys = files.select(F.concat(F.lit("train_demo_"), "source").alias("key"))
    found = tokens.match_domain(named, keys)
    return found.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_distinct("name").alias("n_files")
    )


@query(
    "p3_tokenize",
    with_ctes(
        f"""SELECT doc_id, len(full_tokens)::BIGINT AS n_full, len(cut)::BIGINT AS n_cut,
                   md5(array_to_string(full_tokens, ' ')) AS full_md5, md5(array_to_string(cut, ' ')) AS cut_md5
            FROM (SELECT doc_id, tokens AS full_tokens, list_prepend('{BOS}', tokens)[1:{MAX_LENGTH}] AS cut FROM corpus)""",
        CORPUS,
    ),
)
def tokenize(spark, folder):
    """Whole documents, and documents with a start mark cut to a length."""
    docs = tokens.tokenize(views.corpus(spark, folder), out="full")
    docs = tokens.tokenize(docs, bos=True, max_length=MAX_LENGTH, out="cut")
    return docs.select(
        "doc_id",
        F.size("full").cast("long").alias("n_full"),
        F.size("cut").cast("long").alias("n_cut"),
        text_md5("full").alias("full_md5"),
        text_md5("cut").alias("cut_md5"),
    )


MARKS = ", ".join(f"('{token}', {number}::BIGINT, 0::BIGINT)" for number, token in enumerate(SPECIALS))
VOCAB = f"""
counts AS (SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(tokens) AS token FROM corpus)
           WHERE token NOT IN {SPECIALS!r} GROUP BY token),
vocab AS (SELECT token, id, n FROM (
            SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + {len(SPECIALS) - 1} AS id FROM counts)
          WHERE id < {VOCABULARY}
          UNION ALL SELECT * FROM (VALUES {MARKS}))
"""


@query("p4_build_vocab", with_ctes("SELECT token, id, n FROM vocab", CORPUS, VOCAB))
def build_vocab(spark, folder):
    return tokens.build_vocab(views.corpus_tokens(spark, folder), VOCABULARY)


def encoded(spark, folder, out: str = "tokens") -> DataFrame:
    docs = views.corpus_tokens(spark, folder)
    return tokens.encode_ids(docs, tokens.build_vocab(docs, VOCABULARY), out=out)


@query(
    "p4_encode_ids",
    with_ctes(
        f"""SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE id = 0)::BIGINT AS n_unknown,
                   md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS ids_md5, '{id_width(VOCABULARY)}' AS width
            FROM each_token GROUP BY doc_id""",
        CORPUS,
        VOCAB,
        """each_token AS (SELECT doc_id, pos, coalesce(id, 0) AS id
              FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM corpus)
              LEFT JOIN vocab USING (token))""",
    ),
)
def encode_ids(spark, folder):
    found = encoded(spark, folder, "ids")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n"),
        F.size(F.filter("ids", lambda i: i == 0)).cast("long").alias("n_unknown"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5"),
        F.lit(id_width(VOCABULARY)).alias("width"),
    )


@query(
    "a1_token_distribution",
    with_ctes(f"SELECT domain, n_docs, n_tokens, {r('prior')} AS prior FROM prior", CORPUS, DISTRIBUTION),
)
def token_distribution(spark, folder):
    return views.distribution(spark, folder).withColumn("prior", rounded("prior"))


@query(
    "flagship_prior_plan",
    with_ctes(
        f"""SELECT domain, n_docs, n_tokens, {r('prior')} AS prior,
                   {r('sqrt(prior) / sum(sqrt(prior)) OVER ()')} AS smoothed, {r('least(prior * 15, 1e0)')} AS bound
            FROM prior""",
        CORPUS,
        DISTRIBUTION,
    ),
)
def prior_plan(spark, folder):
    """Token share per domain, smoothed share and usage bound."""
    dist = weights.usage_bounds(views.stored_distribution(spark, folder))
    return weights.temper(dist.withColumn("smoothed", F.col("prior")), by=(), value="smoothed").select(
        "domain", "n_docs", "n_tokens", rounded("prior").alias("prior"), rounded("smoothed").alias("smoothed"),
        rounded("bound").alias("bound"),
    )


# Token ids with their place in the file, then in chunks.
PACKED = f"""
{VOCAB.strip()},
encoded AS (SELECT domain, shard, doc_id, list(coalesce(id, 0)::INTEGER ORDER BY pos) AS tokens
            FROM (SELECT domain, shard, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM corpus)
            LEFT JOIN vocab USING (token) GROUP BY 1, 2, 3),
placed AS (SELECT domain, shard, doc_id, tokens,
                  coalesce(sum(len(tokens)) OVER (PARTITION BY domain, shard ORDER BY doc_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM encoded),
stream AS (SELECT domain, shard, start + pos - 1 AS spot, token
           FROM (SELECT domain, shard, start, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM placed)),
pieces AS (SELECT domain, shard, (spot // {CHUNK})::BIGINT AS chunk_no, list(token ORDER BY spot) AS tokens
           FROM stream GROUP BY 1, 2, 3),
chunks AS (SELECT * FROM pieces WHERE len(tokens) = {CHUNK}),
blocks AS (SELECT domain, shard, chunk_no, block_no, tokens[block_no * {BLOCK} + 1 : block_no * {BLOCK} + {BLOCK}] AS tokens
           FROM (SELECT *, unnest(range({CHUNK // BLOCK})) AS block_no FROM chunks))
"""


def packed(spark, folder, **options) -> DataFrame:
    return packing.pack_chunks(encoded(spark, folder), CHUNK, bucket=views.doc_bucket(), **options)


def chunk_report(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.select(*keys, F.size("tokens").cast("long").alias("n"), text_md5("tokens").alias("tokens_md5"))


CHUNK_REPORT = "len(tokens)::BIGINT AS n, md5(array_to_string(tokens, ' ')) AS tokens_md5"


@query(
    "w7_pack_chunks",
    with_ctes(f"SELECT domain, shard, chunk_no, {CHUNK_REPORT} FROM chunks", CORPUS, PACKED),
)
def pack_chunks(spark, folder):
    return chunk_report(packed(spark, folder), "domain", "shard", "chunk_no")


@query(
    "w7_pack_chunks_with_tail",
    with_ctes(
        f"""SELECT domain, shard, chunk_no, {CHUNK_REPORT}
            FROM (SELECT domain, shard, chunk_no,
                         tokens || list_transform(range({CHUNK} - len(tokens)), lambda i: {SPECIALS.index(BOS)}) AS tokens FROM pieces)""",
        CORPUS,
        PACKED,
    ),
)
def pack_chunks_with_tail(spark, folder):
    return chunk_report(packed(spark, folder, keep_tail=True, pad=SPECIALS.index(BOS)), "domain", "shard", "chunk_no")


@query(
    "w8_packing_report",
    with_ctes(
        f"""SELECT domain, shard, n::BIGINT AS n_tokens, (n // {CHUNK})::BIGINT AS n_chunks,
                   (n // {CHUNK} * {CHUNK})::BIGINT AS kept_tokens, (n % {CHUNK})::BIGINT AS lost_tokens
            FROM (SELECT domain, shard, sum(len(tokens)) AS n FROM corpus GROUP BY 1, 2)""",
        CORPUS,
    ),
)
def packing_report(spark, folder):
    return packing.packing_report(views.corpus_lengths(spark, folder), CHUNK)


@query(
    "p11_slice_blocks",
    with_ctes(
        f"SELECT domain, shard, chunk_no, block_no::BIGINT AS block_no, {CHUNK_REPORT} FROM blocks", CORPUS, PACKED
    ),
)
def slice_blocks(spark, folder):
    blocks = packing.slice_blocks(packed(spark, folder), BLOCK)
    blocks = blocks.withColumn("block_no", F.col("block_no").cast("long"))
    return chunk_report(blocks, "domain", "shard", "chunk_no", "block_no")


@query(
    "p10_shift_targets",
    with_ctes(
        f"""SELECT domain, shard, chunk_no, block_no::BIGINT AS block_no,
                   md5(array_to_string(tokens[1:{BLOCK - 1}], ' ')) AS inputs_md5,
                   md5(array_to_string(tokens[2:{BLOCK}], ' ')) AS targets_md5
            FROM blocks""",
        CORPUS,
        PACKED,
    ),
)
def shift_targets(spark, folder):
    pairs = packing.shift_targets(packing.slice_blocks(packed(spark, folder), BLOCK), BLOCK - 1)
    return pairs.select(
        "domain",
        "shard",
        "chunk_no",
        F.col("block_no").cast("long").alias("block_no"),
        text_md5("input_ids").alias("inputs_md5"),
        text_md5("targets").alias("targets_md5"),
    )


@query(
    "s5_write_chunks",
    with_ctes(
        f"SELECT 'train' AS split, domain, shard, chunk_no, {CHUNK_REPORT} FROM chunks", CORPUS, PACKED
    ),
)
def write_chunks(spark, folder):
    """All chunks, written and read back."""
    path = scratch(spark, "chunks")
    tables.write_chunks(packed(spark, folder).withColumn("split", F.lit("train")), path)
    return chunk_report(tables.read_chunks(spark, path), "split", "domain", "shard", "chunk_no")


@query(
    "s6_read_chunks",
    with_ctes(
        f"""SELECT domain, shard, chunk_no, {CHUNK_REPORT} FROM chunks
            WHERE domain IN (SELECT domain FROM prior WHERE prior > 5e-2)""",
        CORPUS,
        DISTRIBUTION,
        PACKED,
    ),
)
def read_chunks(spark, folder):
    """Chunks of the domains with more than a twentieth of all tokens."""
    path = scratch(spark, "chunks")
    tables.write_chunks(packed(spark, folder).withColumn("split", F.lit("train")), path)
    wanted = views.distribution(spark, folder).where("prior > 0.05")
    return chunk_report(tables.read_chunks(spark, path, wanted), "domain", "shard", "chunk_no")
