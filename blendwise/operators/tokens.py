"""Tokens of documents and their ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from blendwise.functions.names import dash_prefixes, domain_of, shard_of
from blendwise.functions.text import BOS, EOS, SPECIALS, framed, words
from blendwise.session import durable

VOCABULARY_BYTES = 64 << 20  # up to which a vocabulary is sent to the tasks
TOKENS_AT_ONCE = 1 << 19  # that a worker works on, besides the batch that Spark sends


def with_domain(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("domain", domain_of(F.col(path))).withColumn("shard", shard_of(F.col(path)))


def match_domain(files: DataFrame, keys: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """Files ``key-*`` of each key, by equality on the dash prefixes of the name instead of a pattern join."""
    return files.withColumn(key, F.explode(dash_prefixes(F.col(name)))).join(keys.select(key).distinct(), key)


def tokenize(
    df: DataFrame, col: str = "text", bos: bool = False, eos: bool = True, max_length: int = -1, out: str = "tokens"
) -> DataFrame:
    """Words of a text between the optional marks; ``max_length`` cuts after the end mark was added."""
    found = words(F.coalesce(F.col(col), F.lit("")))
    return df.withColumn(out, framed(found, BOS if bos else None, EOS if eos else None, max_length))


def count_tokens(df: DataFrame, col: str = "text", eos: bool = True, out: str = "n_tokens") -> DataFrame:
    length = F.size(words(F.coalesce(F.col(col), F.lit("")))) + F.lit(1 if eos else 0)
    return df.withColumn(out, length.cast("long"))


def build_vocab(df: DataFrame, max_size: int, tokens: str = "tokens") -> DataFrame:
    """The ``max_size`` most frequent tokens with ids, special tokens first; ties go by token.

    Counting combines before its shuffle; only the at most ``max_size`` kept rows are numbered in one place.
    """
    # The outer form: for the inner one Spark adds a size check that would tokenize every text a second time.
    each = df.select(F.explode_outer(tokens).alias("token"))
    counts = each.where(F.col("token").isNotNull() & ~F.col("token").isin(*SPECIALS))
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.orderBy(F.desc("n"), "token").limit(max(max_size - len(SPECIALS), 0))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
    numbered = kept.select("token", (place + len(SPECIALS) - 1).cast("long").alias("id"), "n")
    marks = df.sparkSession.createDataFrame(
        [(token, number, 0) for number, token in enumerate(SPECIALS)], "token string, id long, n long"
    )
    return marks.unionByName(numbered)


def token_slices(batches, column: int, most: int | None = None):
    """The rows of the batches in slices of at most ``most`` tokens in a list column, or of one row.

    A batch may hold thousands of long documents. What is made of a slice is gone before the next one, and a batch
    before the next is read, so that a worker holds little besides the batch itself.
    """
    most = most or TOKENS_AT_ONCE
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, int(ends[first]) + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        del batch, ends


def _encoder(sent, others: list[str], out: str, unk: int):
    """Look up the tokens, in the column after the others, in the vocabulary that was sent (token, id)."""

    def encoded(batch, known, ids):
        lists = batch.column(len(others))
        place = pc.index_in(lists.flatten(), value_set=known, skip_nulls=True)
        found = pa.array(ids[place.fill_null(len(known)).to_numpy()])
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())).astype(np.int32)
        coded = pa.ListArray.from_arrays(pa.array(ends), found, mask=lists.is_null())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(others)], coded], [*others, out])

    def run(batches):
        known = sent.value["token"].combine_chunks()
        ids = np.append(sent.value["id"].to_numpy(), unk).astype(np.int32)
        for batch in token_slices(batches, len(others)):
            yield encoded(batch, known, ids)
            del batch

    return run


def encode_ids(
    df: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "ids", unk: int = 0, limit: int = VOCABULARY_BYTES
) -> DataFrame:
    """The rows with ``out``, an array<int>, in place of ``tokens``; unknown tokens become ``unk``.

    A vocabulary of at most ``limit`` bytes goes to the tasks, and rows are encoded many at a time by a vectorised lookup: they
    stay where they are and no token is shuffled. A larger one is joined on the token. NULL arrays stay NULL.
    """
    vocab = durable(vocab.select("token", F.col("id").cast("int").alias("id")))
    size = vocab.agg(F.sum(F.octet_length("token") + 8)).first()[0] or 0
    if size > limit:
        return _encode_by_join(df, vocab, tokens, out, unk)
    sent = df.sparkSession.sparkContext.broadcast(vocab.toArrow().combine_chunks())
    others = [c for c in df.columns if c != tokens]

    fields = [df.schema[c] for c in others] + [StructField(out, ArrayType(IntegerType()))]
    return df.select(*others, tokens).mapInArrow(_encoder(sent, others, out, unk), StructType(fields))


def _encode_by_join(df: DataFrame, vocab: DataFrame, tokens: str, out: str, unk: int) -> DataFrame:
    """The way for a vocabulary of any size. Rows are stored first, so that their numbers stay fixed.

    Each document asks for a token once, whatever its count, which bounds the rows of the commonest word by the number
    of documents; adaptive execution splits what is left of them.
    """
    keyed = durable(df.withColumn("_row", F.monotonically_increasing_id()))
    asked = keyed.select("_row", F.explode(F.array_distinct(tokens)).alias("token"))
    known = asked.join(vocab, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("_map"))
    each = keyed.join(known, "_row", "left").select("_row", "_map", F.posexplode(tokens).alias("_pos", "token"))
    numbered = each.select("_row", F.struct("_pos", F.coalesce(F.try_element_at("_map", "token"), F.lit(unk)).alias("_id")).alias("_p"))
    ids = numbered.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["_id"]).alias(out))
    empty = F.array().cast("array<int>")
    restored = keyed.join(ids, "_row", "left").drop("_row")
    return restored.withColumn(out, F.when(F.size(tokens) == 0, empty).otherwise(F.col(out))).drop(tokens)
