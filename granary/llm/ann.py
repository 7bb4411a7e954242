"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Every vector's direction is coded with four bits a sub-space, once. Codes minimise the anisotropic loss: the
residual's part along the vector itself, which alone disturbs the largest inner products, weighs more than the rest.
A scan of the codes by lookup tables, of a block of queries in each task, gives each inner product to within
|query| * |vector| * |residual|. All rows that this bound can't rule out are ranked again by their exact distance, so
the neighbours found are the true ones. Vectors stay where they lie; only queries and results travel.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import dropped, saved

LEVELS = 16
#: Rows that the codebooks are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Queries that are sent out together, and the bytes of their vectors, at most.
QUERY_BLOCK, QUERY_BYTES = 65_536, 32 << 20
#: Rows and queries whose tables are scanned together.
ROW_BLOCK, TABLE_BLOCK = 8_192, 32


@dataclass(frozen=True)
class Codebook:
    centres: np.ndarray  # sub-spaces, 16, width
    weight: float  # of the parallel residual, relative to the rest

    @property
    def width(self) -> int:
        return self.centres.shape[2]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (weight - 1) * (r . x/|x|)^2, from the nearest centres."""
        parts = x.reshape(len(x), len(self.centres), self.width)
        gaps = parts[:, :, None, :] - self.centres[None]
        errors = (gaps**2).sum(-1)
        codes = errors.argmin(-1)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        along = (gaps * unit.reshape(parts.shape)[:, :, None, :]).sum(-1)
        rows = np.arange(len(x))
        total = along[rows[:, None], np.arange(len(self.centres)), codes].sum(1)
        for _ in range(rounds):
            for m in range(len(self.centres)):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (errors[:, m] + (self.weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)


def fit(sample: np.ndarray, width: int = 1, threshold: float = 0.2, rounds: int = 8, seed: int = 5) -> Codebook:
    """Codebooks of 16 centres for each ``width`` dimensions.

    The parallel residual's weight follows the published score-aware loss for unit vectors and inner products
    above ``threshold``: (d - 1) t^2 / (1 - t^2), at least 1. Centres move to the weighted means of their rows.
    """
    n, d = sample.shape
    width = width if d % width == 0 else 1
    weight = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    parts = sample.reshape(n, d // width, width)
    centres = np.stack([parts[np.sort(rng.choice(n, LEVELS, replace=n < LEVELS)), m] for m in range(d // width)])
    if width == 1:
        centres = np.quantile(sample, (np.arange(LEVELS) + 0.5) / LEVELS, axis=0).T[:, :, None].copy()
    book = Codebook(centres, weight)
    for _ in range(rounds):
        codes = book.encode(sample, rounds=1)
        moved = book.centres.copy()
        for m in range(len(moved)):
            n_of = np.bincount(codes[:, m], minlength=LEVELS)
            for k in range(width):
                moved[m, :, k] = np.where(n_of > 0, np.bincount(codes[:, m], parts[:, m, k], LEVELS) / np.maximum(n_of, 1), moved[m, :, k])
        book = Codebook(moved, weight)
    return book


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, the components added in their order."""
    gap, total = x - q, np.zeros(len(x))
    for m in range(gap.shape[1]):
        total += gap[:, m] * gap[:, m]
    return np.sqrt(total)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the first in the low bits."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] | even[:, 1::2] << 4


def unpacked(data: np.ndarray, n: int) -> np.ndarray:
    return np.stack([data & 15, data >> 4], -1).reshape(len(data), -1)[:, :n]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length 1, of rows that aren't zero; no square leaves the range of doubles."""
    most = np.abs(x).max(1, keepdims=True)
    y = x / most
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return (most * size)[:, 0], y / size


@dataclass
class Found:
    """Of queries of one length, the nearest rows that a task has met."""

    ids: np.ndarray
    x: np.ndarray
    top: int

    def __post_init__(self):
        self.size, self.unit = directions(self.x)
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in self.ids]

    def scan(self, ids: np.ndarray, x: np.ndarray, book: Codebook | None, codes: np.ndarray | None, norm: np.ndarray, gap: np.ndarray) -> None:
        """Looks at rows of vectors; without a codebook all are measured."""
        for start in range(0, len(self.ids), TABLE_BLOCK):
            unit = self.unit[start : start + TABLE_BLOCK]
            if book is not None:
                tables = np.einsum("qmw,mkw->mkq", unit.reshape(len(unit), -1, book.width), book.centres).astype(np.float32)
                score = np.zeros((len(x), len(unit)), np.float32)
                for m, table in enumerate(tables):
                    score += table[codes[:, m]]
            for j in range(len(unit)):
                q, other = start + j, ids != self.ids[start + j]
                scores, names = self.best[q]
                if book is not None:
                    with np.errstate(over="ignore", invalid="ignore"):
                        both = 2 * self.size[q] * norm
                        near = self.size[q] ** 2 + norm**2 - both * score[:, j]
                        # the residual's reach, float32's rounding in the sum, and that of doubles
                        reach = both * (gap + 1.2e-7 * len(tables) * (1 + gap)) + 1e-12 * (self.size[q] ** 2 + norm**2)
                        if len(scores) == self.top:
                            limit = scores[-1] ** 2
                        else:
                            high = np.where(other, near + reach, np.inf)
                            k = min(self.top, len(high)) - 1
                            limit = np.partition(high, k)[k]
                        rows = np.flatnonzero(other & ~(near - reach > limit))  # also what isn't a number
                else:
                    rows = np.flatnonzero(other)
                if len(rows):
                    exact, which = np.concatenate([scores, distances(self.x[q], x[rows])]), np.concatenate([names, ids[rows]])
                    first = np.lexsort((which, exact))[: self.top]
                    self.best[q] = exact[first], which[first]


CODED = "id long, x array<double>, codes binary, norm double, gap double"


def coded(rows: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """id and x with packed codes (null for a length without a codebook), length and the residual of the direction."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                part = big.slice(at, 2048)
                for d, where in by_length(part["x"]):
                    x = matrix(part["x"], where, d)
                    norm, unit = directions(x)
                    book, codes, gap = books.get(d), [None] * len(x), np.zeros(len(x))
                    if book is not None:
                        c = book.encode(unit)
                        gap, codes = np.linalg.norm(unit - book.decode(c), axis=1), [r.tobytes() for r in packed(c)]
                    yield pa.RecordBatch.from_arrays([part["id"].take(where), part["x"].take(where), pa.array(codes, pa.binary()), pa.array(norm), pa.array(gap)], names=["id", "x", "codes", "norm", "gap"])

    return rows.mapInArrow(encode, CODED)


def by_length(x: pa.ListArray) -> Iterator[tuple[int, pa.Array]]:
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), pa.array(np.flatnonzero(sizes == d))


def matrix(x: pa.ListArray, where: pa.Array, d: int) -> np.ndarray:
    return x.take(where).flatten().to_numpy(zero_copy_only=False).reshape(len(where), d)


def searched(vectors: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], books: dict[int, Codebook], top: int) -> DataFrame:
    """query_id, vec_id, score: of each partition of the coded vectors, its ``top`` nearest rows to each query.

    asked: by length, ids and vectors.
    """
    # plain arrays: a worker need not import this module to read them
    shared = vectors.sparkSession.sparkContext.broadcast((asked, {d: (b.centres, b.weight) for d, b in books.items()}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, plain = shared.value
        books = {d: Codebook(*b) for d, b in plain.items()}
        found = {d: Found(ids, x, top) for d, (ids, x) in queries.items()}
        for big in batches:
            for at in range(0, big.num_rows, ROW_BLOCK):
                part = big.slice(at, ROW_BLOCK)
                for d, where in by_length(part["x"]):
                    if d not in found:
                        continue
                    norm, gap = (part[c].take(where).to_numpy() for c in ("norm", "gap"))
                    book, codes = books.get(d), None
                    if book is not None:
                        n = len(book.centres)
                        codes = unpacked(np.frombuffer(b"".join(part["codes"].take(where).to_pylist()), np.uint8).reshape(-1, (n + 1) // 2), n)
                    found[d].scan(part["id"].take(where).to_numpy(), matrix(part["x"], where, d), book, codes, norm, gap)
        for f in found.values():
            for i in range(0, len(f.ids), 1000):
                best = f.best[i : i + 1000]
                names = np.repeat(f.ids[i : i + 1000], [len(ids) for _, ids in best])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([ids for _, ids in best])), pa.array(np.concatenate([x for x, _ in best]))], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(scan, "query_id long, vec_id long, score double")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` nearest rows by Euclidean distance, its own id left out.

    Ties go to the smaller id. Rows whose vector is null, empty, zero or holds a null or non-finite component, or
    whose id is null, take no part. A query meets the vectors of its own length; codebooks are fitted for the lengths
    in a sample of SAMPLE_ROWS rows, vectors of another length are measured one by one. Components of any finite size
    are taken: codes are of directions. Rows with a repeated id count as so many candidates; a query repeated with id
    and vector counts once; an empty table gives no row. Queries go out in blocks of QUERY_BLOCK, each of which one
    scan of the codes answers: a partition passes on ``top`` rows a query, and a common vector, lying in many
    partitions, makes none large. Other columns, whatever their names, are not read.
    """
    read = lambda df: df.where(usable(df[vector_col]) & df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("x"))
    rows, asked = read(vectors), saved(read(queries).dropDuplicates(), "queries")
    n = rows.count()
    n_asked, longest = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a bounded sample by hash of the id: the same rows at every run
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).select("x").limit(SAMPLE_ROWS)
    sample = [np.array(r["x"]) for r in drawn.toLocalIterator()]
    books = {d: fit(directions(np.stack([v for v in sample if len(v) == d]))[1]) for d, k in Counter(map(len, sample)).items() if k >= LEVELS}
    at = saved(coded(rows, books), "vectors")
    size = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * longest)))
    blocks = -(-n_asked // size)
    parts = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)) == b).toLocalIterator()
        grouped: dict[int, list] = {}
        for r in held:
            grouped.setdefault(len(r["x"]), []).append(r)
        block = {d: (np.array([r["id"] for r in rs], np.int64), np.array([r["x"] for r in rs])) for d, rs in grouped.items()}
        part = searched(at, block, books, top)
        parts.append(part if blocks == 1 else saved(part, "found"))
    met = parts[0]
    for part in parts[1:]:
        met = met.unionAll(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    out = saved(out, "nearest")
    dropped(asked, at, *(p for p in parts if blocks > 1))
    return out
