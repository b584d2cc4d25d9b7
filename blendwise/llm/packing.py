"""Lexical retrieval packing: related documents share a training sequence.

Token ids are made once and stored. Documents are dealt by a lexical signature, so that copies and documents about
the same rare terms meet; each task walks its part in shards of bounded size. A shard has a BM25 inverted index whose
document frequencies and mean length come from the whole corpus. A seed document opens a window; the index returns its
nearest unused neighbours, which fill the window greedily: the best that fits whole, and when none fits, the best one
cut. Windows stay open across shards, so only the last window of a task is short; it is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import map_rows, stored

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
SHARD_DOCS = 384
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, by their distinct white-space chunks and a memory of chunks seen before.

    The tokenizer's own rules never join characters across white space, ignore case and drop white space, so the
    ids of a text are those of its chunks. Marks after a letter are chunks of their own. Plain words need none of its
    normalising and splitting: new ones go to its merge model thousands at a time, in one line, and are told apart by
    the tokens that end a word. All others take the whole way. Strings of special tokens are ordinary text. Arrow
    splits the texts and numbers their chunks, so that each is an object of Python but once in a batch.
    """

    KEEP = 150_000  # chunks of a generation; the one before it is kept too
    MARKS = "([a-z])([.,;:!?])"  # between a letter and a mark the tokenizer always splits
    LINE = 4096  # words that go to the model together

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = self.tokenizer.model.tokenize
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [chr(c) for c in range(0x80, 0x180)]
        self.spelling = {byte: sign for c in letters for byte, sign in zip(c.encode(), spelled(c)[0][0])}
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        self.end = np.array([END_ID], self.kind).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.past: dict[str, bytes] = {}

    def _model(self, piece: str) -> bytes:
        found = self.pieces(piece)
        return struct.pack(f"<{len(found)}{self.code}", *[t.id for t in found])

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether a chunk is all letters that the tokenizer leaves in one piece."""
        if not word.isalpha() or max(word) >= "\u0180":
            return False
        low = word.lower()  # single letters up to U+017F have one lower-case form and nothing to compose
        return low.isalpha() and len(low) == len(word)

    def _learn_words(self, words: list[str]) -> None:
        """Add the ids of plain words."""
        for at in range(0, len(words), self.LINE):
            part = words[at : at + self.LINE]
            line = " ".join(part)
            if not line.isascii():
                line = line.lower().encode().decode("latin-1").translate(self.spelling)
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # the vocabulary does not mark the end of each word
                self.known.update((w, self._model(piece)) for w, piece in zip(part, line.split(" ")))
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(part, (ends * self.kind.itemsize).tolist()):
                self.known[word] = data[start:end]
                start = end

    def _learn(self, new: list[str]) -> None:
        self._learn_words([c for c in new if c.isascii() and c.isalpha()])
        rest = [c for c in new if not (c.isascii() and c.isalpha())]
        plain = [c for c in rest if self._plain(c)]
        self._learn_words(plain)
        hard = list(set(rest).difference(plain))
        for at in range(0, len(hard), self.LINE):
            part = hard[at : at + self.LINE]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for chunk, encoding in zip(part, found):
                self.known[chunk] = struct.pack(f"<{len(encoding.ids)}{self.code}", *encoding.ids)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        lower = pc.replace_substring_regex(pc.ascii_lower(texts), self.MARKS, r"\1 \2")
        chunks = pc.ascii_split_whitespace(lower)
        coded = pc.dictionary_encode(chunks.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.KEEP:  # what is used again moves on to the next generation
            self.past, self.known = self.known, {"": b""}
        known, past = self.known, self.past
        new = [c for c in each if c not in known]
        if past:
            known.update((c, past[c]) for c in new if c in past)
            new = [c for c in new if c not in past]
        self._learn(new)
        found = [known[c] for c in each]
        bank = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        places = coded.indices.to_numpy()
        lengths = sizes[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        starts = (np.cumsum(sizes) - sizes)[places]
        data = bank[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        words = np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy())
        cuts = [0, *(ends[words] * self.kind.itemsize).tolist()]
        return [data[a:b] + self.end for a, b in zip(cuts, cuts[1:])]


@functools.cache
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process: it loads once, and words stay known from task to task."""
    return Encoder(path)


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, sig, n, ids): ids little-endian, with the end mark; two or four bytes each by vocabulary.

    ``sig`` orders documents by their two rarest terms in the merge order of the tokenizer, which lists common pieces
    first: copies and documents about the same odd thing come to stand together.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        encoder = worker_encoder(path)

        def signature(ids: np.ndarray) -> int:
            first = ids.max()
            rest = ids[ids < first]
            return int(first) << 32 | int(rest.max() if len(rest) else first)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = encoder.encode(batch.column(2))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([signature(np.frombuffer(c, encoder.kind)) for c in coded], pa.int64()),
                    pa.array([len(c) // encoder.kind.itemsize for c in coded], pa.int64()),
                    pa.array(coded, pa.binary()),
                ],
                ["doc_id", "row_hash", "sig", "n", "ids"],
            )

        return work

    rows = docs.select(id_col, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("h"), text_col)
    return map_rows(rows, make, f"doc_id {kind}, row_hash long, sig long, n long, ids binary")


def document_frequencies(tokens: DataFrame, vocabulary: int, width: int) -> tuple[np.ndarray, int, float]:
    """Documents per term, number of documents and mean length, over all rows.

    Tasks count into one array of the vocabulary's size; at most that many sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}")
                places = np.arange(len(ids))
                last[ids] = places
                found[ids[last[ids] == places]] += 1  # one place of each term
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(found[terms])], ["term", "docs"])

    rows = tokens.select("ids").mapInArrow(count, "term long, docs long")
    frequency = np.zeros(vocabulary, np.int64)
    for row in rows.groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        frequency[row.term] = row.docs
    sums = tokens.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean")).first()
    return frequency, sums.k, sums.mean or 1.0


class Shard:
    """A BM25 index over the unused pieces of a bounded number of documents."""

    def __init__(self, pieces: list[list], idf: np.ndarray, mean: float):
        self.pieces = pieces  # [doc, ids, start, terms]
        self.lengths = np.array([len(p[1]) for p in pieces])
        self.unused = np.ones(len(pieces), bool)
        counted = [np.unique(p[1], return_counts=True) for p in pieces]
        for piece, (terms, _) in zip(pieces, counted):
            piece[3] = terms
        terms = np.concatenate([c[0] for c in counted])
        tf = np.concatenate([c[1] for c in counted]).astype(np.float32)
        owner = np.repeat(np.arange(len(pieces)), [len(c[0]) for c in counted])
        norm = (K1 * (1 - B + B * self.lengths / mean)).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        self.owner = owner[order]
        self.weight = (idf[terms] * tf * (K1 + 1) / (tf + norm[owner]))[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(idf)))])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        begin, size = self.begin[terms], self.begin[terms.astype(np.int64) + 1] - self.begin[terms]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], self.weight[at], minlength=len(self.pieces))

    def ranking(self, terms: np.ndarray) -> np.ndarray:
        """Unused pieces, most similar first, ties in shard order."""
        order = np.argsort(-self.scores(terms), kind="stable")
        return order[self.unused[order]]


class Packer:
    """Fills windows one after the other; ``put`` receives (doc, start, ids, sequence, offset)."""

    def __init__(self, window: int, first_id: int, put):
        self.window, self.next_id, self.put = window, first_id, put
        self.filled, self.content, self.seed = 0, [], None

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        self.content.append((doc, start, ids))
        self.filled += len(ids)
        if self.filled == self.window:
            self.close()

    def close(self) -> None:
        offset = 0
        for doc, start, ids in self.content:
            self.put(doc, start, ids, self.next_id, offset)
            offset += len(ids)
        self.next_id += 1
        self.filled, self.content, self.seed = 0, [], None

    def whole(self, doc, ids: np.ndarray) -> int:
        """Full windows of one document, as their own sequences; returns where the rest begins."""
        end = len(ids) - len(ids) % self.window
        for start in range(0, end, self.window):
            self.put(doc, start, ids[start : start + self.window], self.next_id, 0)
            self.next_id += 1
        return end

    def fill(self, shard: Shard) -> None:
        while shard.unused.any():
            if self.seed is None:
                first = int(np.argmax(shard.unused))
                self.seed = shard.pieces[first][3]
                order = np.concatenate([[first], (r := shard.ranking(self.seed))[r != first]])
            else:
                order = shard.ranking(self.seed)
            while self.seed is not None and len(order):
                room = self.window - self.filled
                fits = np.flatnonzero(shard.lengths[order] <= room)
                pick = int(fits[0]) if len(fits) else 0
                at = int(order[pick])
                doc, ids, start, _ = shard.pieces[at]
                taken = ids[:room]
                if len(taken) == len(ids):
                    shard.unused[at] = False
                    order = np.delete(order, pick)
                else:
                    shard.pieces[at][1], shard.pieces[at][2] = ids[room:], start + room
                    shard.lengths[at] = len(ids) - room
                self.add(doc, start, taken)

    def finish(self) -> None:
        """Cut the open window into sequences of powers of two, the largest first."""
        left, content = self.filled, self.content
        self.filled, self.content = 0, []
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while size:
                doc, start, ids = content.pop(0)
                if len(ids) > size:
                    content.insert(0, (doc, start + size, ids[size:]))
                    ids = ids[:size]
                size -= len(ids)
                self.content.append((doc, start, ids))
            self.close()


def pack_documents(
    docs: DataFrame,
    window: int = WINDOW,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document's ids end with the mark ``END_ID``; NULL and empty texts are that mark alone. Every id lies in one
    piece. Sequences have ``window`` ids, but for those at the end of a task, whose lengths are powers of two
    (``window`` itself should be one). Repeated rows are separate documents. Pieces of an empty table are none.
    Memory of a task is bounded by ``shard_docs``, ``shard_tokens`` and the longest document.
    """
    path = tokenizer or tokenizer_path()
    encoder = Encoder(path)
    vocabulary, width = encoder.tokenizer.get_vocab_size(), encoder.kind.itemsize
    tokens = stored(token_table(docs, path, id_col, text_col), "tokens")
    frequency, number, mean = document_frequencies(tokens, vocabulary, width)
    idf = np.log1p((number - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_encoder.cache_clear()  # its memory is needed here
        rows: list[tuple] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        types = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def put(doc, start, ids, sequence, offset):
            full = ids.astype("<u4")
            row = (doc[0], start, len(ids), zlib.crc32(full.tobytes()), doc[1], sequence, offset)
            rows.append((*row, full.astype(np.int32)) if with_ids else row)

        def flush(id_type) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(c, t or id_type) for c, t in zip(columns, types)]
            if with_ids:
                arrays.append(pa.array(columns[-1], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [*names, "ids"] if with_ids else names)

        packer = Packer(window, TaskContext.get().partitionId() << 32, put)
        pieces, held, id_type = [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for key, n, value in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids = np.frombuffer(value.as_buffer().to_pybytes(), f"<u{width}")
                doc = (key.as_py(), n.as_py())
                start = packer.whole(doc, ids)
                if start < len(ids):
                    pieces.append([doc, ids[start:], start, None])
                    held += len(ids) - start
                if len(pieces) >= shard_docs or held >= shard_tokens:
                    packer.fill(Shard(pieces, idf, mean))
                    pieces, held = [], 0
                if len(rows) >= 2000:
                    yield flush(id_type)
        if pieces:
            packer.fill(Shard(pieces, idf, mean))
        packer.finish()
        if rows:
            yield flush(id_type)

    # Range bounds follow the real distribution; the row hash splits signatures that many documents share.
    dealt = tokens.repartitionByRange("sig", "row_hash").sortWithinPartitions("sig", "row_hash", "doc_id")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.select("doc_id", "n", "ids").mapInArrow(pack, schema + (", ids array<int>" if with_ids else ""))
