"""Built-in word tokens, and optional subword tokenizers applied to Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Special tokens and the pattern of a word.
UNKNOWN, BOS, EOS = "<unk>", "<s>", "</s>"
SPECIALS = (UNKNOWN, BOS, EOS)
WORD = r"[^\s\x0B]+"
# Vocabularies below this size fit 16-bit ids.
NARROW_VOCABULARY = 65500


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def framed(tokens: Column, bos, eos, max_length: int = -1) -> Column:
    """Put ``bos`` in front and ``eos`` behind unless None; cutting comes last, so it can remove the end mark."""
    pieces = [F.array(F.lit(bos))] if bos is not None else []
    pieces.append(tokens)
    if eos is not None:
        pieces.append(F.array(F.lit(eos)))
    whole = F.concat(*pieces) if len(pieces) > 1 else tokens
    return F.slice(whole, 1, max_length) if max_length > 0 else whole


def id_width(vocabulary_size: int) -> str:
    return "uint16" if vocabulary_size < NARROW_VOCABULARY else "int32"
