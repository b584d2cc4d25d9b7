"""Vector codes by ball k-means: one codebook per part of the vector, one byte-sized code per part.

Components are scaled to integers, so that distances, sums and ties are exact. An entry with the parts assigned to it
forms a ball. Another entry can be nearer to a part only if it lies within twice the part's distance to its own entry
(triangle inequality); so the radius of the ball names the neighbour entries, parts closer than half the way to the
nearest neighbour form the stable core and are not looked at, and parts in the ring between two neighbours' half ways
are compared with the neighbours inside of it only. Balls are taken per batch of a task: smaller ones have tighter radii.

Each round writes the rows with their codes to the shared folder and adds up the parts of every entry in the tasks; only
codebooks (parts x entries vectors) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.session import discard, scratch

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BATCH = 10_000
EXACT = 1 << 25  # components up to which 64-bit sums of squares are exact for up to 1024 of them
SMALL = 100_000  # labels up to which their sums are broadcast

Books = list[list[list[int]]]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); beyond ``EXACT`` as Python integers, which have no bounds."""
    scaled = np.floor(values * SCALE) if np.abs(values).max(initial=0) < EXACT / SCALE else None
    if scaled is not None:
        return scaled.astype(np.int64)
    whole = lambda x: int(x // 1) * SCALE + int(np.floor((x % 1) * SCALE))
    return np.array([[whole(float(x)) for x in row] for row in values], object)


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    step = points - entry
    return (step * step).sum(axis=1)


def nearest_entries(points: np.ndarray, book: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and its squared distance.

    ``start``: some entry for each part, the nearer the better; without it all entries are compared.
    """
    if start is None:
        code, best = np.zeros(len(points), np.int64), _squares(points, book[0])
        for entry in range(1, len(book)):
            found = _squares(points, book[entry])
            nearer = found < best
            code[nearer], best[nearer] = entry, found[nearer]
        return code, best
    code, best = start.astype(np.int64), np.zeros(len(points), points.dtype)
    for entry in np.unique(start):
        ball = np.flatnonzero(start == entry)
        own = _squares(points[ball], book[entry])
        between = _squares(book, book[entry])
        others = sorted((between[j], j) for j in range(len(book)) if j != entry)
        others = [(far, j) for far, j in others if far <= 4 * own.max()]  # neighbours of the ball
        ring = np.searchsorted(np.array([far for far, _ in others], points.dtype), 4 * own, side="right")
        least, mine = own.copy(), np.full(len(ball), entry)
        for place, (_, other) in enumerate(others):
            near = np.flatnonzero(ring > place)  # outside the stable core and the inner rings
            found = _squares(points[ball[near]], book[other])
            nearer = (found < least[near]) | (found == least[near]) & (other < mine[near])
            least[near[nearer]], mine[near[nearer]] = found[nearer], other
        code[ball], best[ball] = mine, least
    return code, best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return integers(flat.reshape(len(column), -1))


def _book_arrays(books: Books, kind: np.dtype) -> list[np.ndarray]:
    big = max((abs(x) for book in books for entry in book for x in entry), default=0) > EXACT
    return [np.array(book, object if big else kind) for book in books]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def assign(rows: DataFrame, books: Books) -> DataFrame:
    """The rows (vec_id, label, vector, code, error) with new codes and their squared errors, summed over parts."""
    parts = len(books)

    def run(batches):
        for batch in _batches(batches):
            points = _matrix(batch.column(2))
            found = _book_arrays(books, points.dtype)
            width, old = points.shape[1] // parts, batch.column(3)
            before = None if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(-1, parts)
            codes, errors = np.empty((len(points), parts), np.uint8), 0
            for part, book in enumerate(found):
                mine = points[:, part * width : (part + 1) * width]
                mine = mine.astype(object) if book.dtype == object else mine
                code, error = nearest_entries(mine, book, None if before is None else before[:, part])
                codes[:, part], errors = code, errors + error
            errors = pa.array([e if e < 1 << 63 else None for e in map(int, errors)], pa.int64())
            coded = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], coded, errors], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def part_sums(rows: DataFrame, parts: int, entries: int) -> DataFrame:
    """(part, entry, n, total): how many parts each entry has and their componentwise sum, as decimal text.

    Each task adds up its own rows first, so at most parts x entries rows of a task are shuffled.
    """
    schema = "part int, entry int, n long, total string"

    def run(batches):
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in _batches(batches):
            points = _matrix(batch.column(0))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            width = points.shape[1] // parts
            for part in range(parts):
                for entry in np.unique(codes[:, part]):
                    mine = points[codes[:, part] == entry, part * width : (part + 1) * width]
                    key = part, int(entry)
                    counts[key] = counts.get(key, 0) + len(mine)
                    sums[key] = [a + int(b) for a, b in zip(sums.get(key, [0] * width), mine.sum(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.int32()),
                pa.array([k[1] for k in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
                pa.array([",".join(map(str, sums[k])) for k in counts], pa.string()),
            ],
            ["part", "entry", "n", "total"],
        )

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in found["total"]:
            numbers = list(map(int, text.split(",")))
            total = numbers if total is None else [a + b for a, b in zip(total, numbers)]
        first = found.iloc[0]
        return pd.DataFrame(
            {"part": [first["part"]], "entry": [first["entry"]], "n": [found["n"].sum()], "total": [",".join(map(str, total))]}
        )

    each = rows.select("vector", "code").mapInArrow(run, schema)
    return each.groupBy("part", "entry").applyInPandas(merge, schema)


def _usable(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = F.col(vector_col)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    return rows.where(vector.isNotNull() & ~odd & (F.size(vector) > 0) & (F.size(vector) % parts == 0))


def train_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Books]:
    """(vec_id, label, vector, code, error) of all usable rows under the final codebooks, and these.

    Rows without a vector, with NULL or non-finite components, or of a length that cannot be cut into ``parts`` are
    dropped, and so are those whose length differs from that of the smallest id. Codebooks start as the parts of the
    ``entries`` smallest distinct ids (fewer, if there are no more; of a repeated id the smallest vector). Each round
    assigns all parts and moves each entry to floor(sum / count) of its parts; entries without parts stay. Rows without id
    take part but never start an entry. ``error`` is NULL if it passes 64 bits. An empty table has empty codebooks.
    """
    if entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    spark = vectors.sparkSession
    rows = _usable(vectors, parts, id_col, vector_col, label_col)
    known = rows.where("vec_id IS NOT NULL")
    first = known.groupBy("vec_id").agg(F.max(F.size("vector")).alias("size")).orderBy("vec_id").limit(1).collect()
    if not first:
        empty = rows.limit(0).select("*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty, [[] for _ in range(parts)]
    length = first[0]["size"]
    rows, known = (df.where(F.size("vector") == length) for df in (rows, known))
    ids = [r["vec_id"] for r in known.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    starts = known.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id")
    seeds = integers(np.array([r["vector"] for r in starts.collect()], np.float64)).tolist()  # at most ``entries`` rows
    width = length // parts
    books = [[seed[p * width : (p + 1) * width] for seed in seeds] for p in range(parts)]
    state = rows.select("*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    path = None
    for turn in range(rounds + 1):
        new = scratch(spark, "codes")
        assign(state, books).write.parquet(new)
        state = spark.read.schema(state.schema).parquet(new)
        if path:
            discard(spark, path)
        path = new
        if turn < rounds:
            for r in part_sums(state, parts, len(seeds)).collect():  # parts x entries rows
                books[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r["total"].split(",")]
    return state, books


def books_digest(books: Books) -> str:
    numbers = [str(x) for book in books for entry in book for x in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all usable rows; see ``train_codes``.

    ``code`` has two hex digits for each part; ``label_error`` sums the errors of all rows with the same label, NULL
    labels together, and is NULL if the sum passes 64 bits. Repeated rows get equal codes and all count.
    """
    rows, books = train_codes(vectors, **options)
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = rows.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "_label")
    small = sums.count() <= SMALL
    joined = rows.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
