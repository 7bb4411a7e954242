"""Packing of tokenized documents into sequences of bounded length, as few as can be.

A plan is made from the number of pieces of each length alone. Lengths are taken from the longest down; a sequence that a
length opens is completed by one, two or three pieces that fill its gap exactly, found by hashing sums of the lengths that
are still available, after further longest pieces where no three suffice. The combination is used as often as its
lengths last. Lengths that nothing completes go last, by best fit. The plan grows with the sequence's length, not with the
corpus: each combination stands once, with its number of copies. Pieces are then numbered within their lengths by a
distributed sort and look their place up.
"""

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import new_folder, ranked
from granary.llm.token_files import stored_as, tokenized


class Available:
    """Numbers of pieces by length, with a bit for each length that is left, and the same bits mirrored."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.bits, self.mirrored = Counter(), capacity, 0, 0
        for length, n in counts.items():
            self.change(length, n)

    def change(self, length: int, n: int) -> None:
        had, self.left[length] = self.left[length] > 0, self.left[length] + n
        if had != (self.left[length] > 0):
            self.bits ^= 1 << length
            self.mirrored ^= 1 << self.capacity - length

    def longest(self, limit: int) -> int:
        """The longest length up to ``limit`` that is left, or 0."""
        return (self.bits & (1 << limit + 1) - 1).bit_length() - 1 if self.bits & (1 << limit + 1) - 1 else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two pieces of that total length, the longer as long as can be: one look at which lengths have a complement."""
        both = self.bits & self.mirrored >> self.capacity - total
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return None
            if 2 * a > total or self.left[a] > 1:
                return a, total - a
            both ^= 1 << a
        return None

    def complement(self, gap: int) -> list[int] | None:
        """One, two or three pieces that fill the gap exactly; longer pieces first."""
        if self.bits >> gap & 1:
            return [gap]
        if two := self.pair(gap):
            return list(two)
        a = self.longest(gap - 1)
        while 3 * a >= gap:
            self.change(a, -1)
            two = self.pair(gap - a)
            self.change(a, 1)
            if two:
                return [a, *two]
            a = self.longest(a - 1)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences that hold all pieces: for each, how many pieces of each length, and how many such sequences there are."""
    out: list[tuple[dict[int, int], int]] = []
    have, rest = Available({k: n for k, n in counts.items() if n}, capacity), Counter()
    while first := have.longest(capacity):
        held, gap = [first], capacity - first
        have.change(first, -1)
        while gap:
            if exact := have.complement(gap):
                held += exact
                for x in exact:
                    have.change(x, -1)
                gap = 0
            elif longest := have.longest(gap):
                # as many of the longest as fit leave the smaller gap to the search
                held.append(longest)
                have.change(longest, -1)
                gap -= longest
            else:
                break
        for x in held:
            have.change(x, 1)
        uses = Counter(held)
        if gap:  # nothing completes it
            rest[first] += have.left[first]
            have.change(first, -have.left[first])
            continue
        copies = min(have.left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            have.change(x, -copies * n)
        out.append((dict(uses), copies))
    return out + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each piece into the open sequence with the smallest gap that takes it; equal sequences together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, uses: dict[int, int], copies: int) -> None:
        if copies:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((uses, copies))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if fresh := at == len(gaps):
                gap, uses, copies = capacity, {}, n
            else:
                gap = gaps[at]
                uses, copies = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            each = min(gap // length, n)
            full = min(copies, n // each)
            over = n - full * each if full < copies else 0  # what one more takes
            put(gap - each * length, uses | {length: each}, full)
            if over:
                put(gap - over * length, uses | {length: over}, 1)
            if not fresh:
                put(gap, uses, copies - full - (over > 0))
            n -= full * each + over
    return [x for held in open_.values() for x in held]


@dataclass(frozen=True)
class Places:
    """For numbers of pieces, counted through the lengths in ascending order: from ``start`` on, sequences from
    ``sequence`` on take ``each`` pieces of ``length`` at ``offset``."""

    start: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(planned: list[tuple[dict[int, int], int]]) -> "Places":
        rows, sequence = [], 0
        for uses, copies in planned:
            offset = 0
            for length in sorted(uses, reverse=True):
                rows.append((length, sequence, uses[length], offset, uses[length] * copies))
                offset += length * uses[length]
            sequence += copies
        length, first, each, offset, n = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else [np.empty(0, np.int64)] * 5
        return Places(np.cumsum(n) - n, first, each, offset, length)

    def look(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        at = np.searchsorted(self.start, number, "right") - 1
        copy, nth = np.divmod(number - self.start[at], self.each[at])
        return self.sequence[at] + copy, self.offset[at] + nth * self.length[at]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """doc_id, piece, start, length, ids_crc32, ids of each piece of each row, and the type of ids."""
    with open(tokenizer_path) as f:  # the vocabulary is a local file of a few megabytes
        tokenizer_json = f.read()
    kind = stored_as(max(tokenizers.Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1))
    size = capacity * np.dtype(kind).itemsize

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 500):
                part = x.slice(at, 500)
                rows = [(d, i // size, ids[i : i + size]) for d, ids in zip(part["doc_id"].to_pylist(), part["ids"].to_pylist()) for i in range(0, len(ids), size)]
                wide = [np.frombuffer(ids, kind).astype("<u4") for *_, ids in rows]
                nth = np.array([n for _, n, _ in rows], np.int32)
                cols = [pa.array([d for d, *_ in rows], pa.int64()), pa.array(nth), pa.array(nth.astype(np.int64) * capacity), pa.array([len(w) for w in wide], pa.int64()), pa.array([crc32(w) for w in wide], pa.int64()), pa.array([ids for *_, ids in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return tokenized(docs, tokenizer_json, kind, end_id, id_col, text_col).mapInArrow(parts, PIECES), kind


def write_packed(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenizes, cuts and plans; writes the pieces' ids and their places as Parquet files below ``path``.

    ``pieces`` has row (a number), doc_id, piece, start, length, ids_crc32, ids; ``places`` has the same without ids, and
    sequence_id and offset. Null and empty texts are the end id alone; rows with a null id and repeated rows are packed
    like all others, each for itself; only documents longer than a sequence are cut, whatever their length; an empty table
    gives no sequence. Other columns, whatever their names, are not read. The number of sequences depends on the lengths
    alone; rows alike in id and length may change places at a rerun.
    """
    pieces, kind = cut(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    pieces.select(F.monotonically_increasing_id().alias("row"), "*", F.lit(kind).alias("kind")).write.option("compression", "zstd").parquet(f"{path}/pieces")
    slim = read_pieces(spark, path).drop("ids", "kind")
    # by length, then in ranges: pieces of one length, however many, spread over tasks
    numbered = ranked(slim, [F.col("length"), F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("row")], "number")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many as a sequence is long, at most
    places = Places.of(plan(counts, capacity))
    shared = spark.sparkContext.broadcast((places.start, places.sequence, places.each, places.offset, places.length))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Places(*shared.value)
        for x in batches:
            kept = [c for c in x.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*x.select(kept).columns, *map(pa.array, table.look(x["number"].to_numpy()))], names=[*kept, "sequence_id", "offset"])

    kept = ", ".join(f"{c} {t}" for c, t in slim.dtypes)
    numbered.mapInArrow(place, f"{kept}, sequence_id long, offset long").write.option("compression", "zstd").parquet(f"{path}/places")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"row long, {PIECES}, kind string").parquet(f"{path}/pieces")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"row long, {PIECES.removesuffix(', ids binary')}, sequence_id long, offset long").parquet(f"{path}/places")


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """sequence_id, n_ids, doc_ids, lengths, ids: each sequence whole, its pieces' documents and lengths in their order."""
    rows = read_places(spark, path).join(read_pieces(spark, path).select("row", "ids", "kind"), "row")
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids", "kind"))).alias("p")  # a sequence's, so bounded

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = [np.concatenate([np.frombuffer(p["ids"], p["kind"]) for p in ps]).astype(np.int64) for ps in x["p"].to_pylist()]
            yield pa.RecordBatch.from_arrays([x["sequence_id"], pa.array([len(i) for i in ids], pa.int64()), x["doc_ids"], x["lengths"], pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "n_ids", "doc_ids", "lengths", "ids"])

    return rows.groupBy("sequence_id").agg(held).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), "p").mapInArrow(whole, "sequence_id long, n_ids long, doc_ids array<long>, lengths array<long>, ids array<long>")


def packed(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, from the files of :func:`write_packed`
    (default place: the shared folder)."""
    path = path or new_folder(spark, "packed")
    write_packed(spark, docs, path, tokenizer_path, capacity, end_id, id_col, text_col)
    return read_places(spark, path).drop("row")
