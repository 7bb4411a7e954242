"""Hard-negative mining by blocked dense matrix products.

Anchor vectors are sent out in blocks and multiplied with blocks of candidates where these lie, in doubles, which are
exact for whole numbers below 2^53. A first pass keeps each anchor's nearest rows of its own label; a task's best merge
with those of the others. They set the windows of a second pass, which keeps for each anchor and positive the nearest
rows of other labels that score within a share of the positive. Only bounded bests leave a task, whatever the data.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.ann import by_length, matrix
from granary.llm.common import dropped, saved

#: Anchors that are sent out together, and the bytes of their vectors, at most.
ANCHOR_BLOCK, ANCHOR_BYTES = 16_384, 32 << 20
#: Candidates and anchors of one matrix product.
ROW_BLOCK, PRODUCT_BLOCK = 8_192, 256
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x), and each row's greatest magnitude."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    return q, np.abs(q).max(1, initial=0.0)


def products(a: np.ndarray, a_most: np.ndarray, x: np.ndarray, x_most: np.ndarray, scale: int, a_raw: np.ndarray, x_raw: np.ndarray) -> np.ndarray:
    """Whole inner products; where doubles could round, by whole numbers of any size, held within a long's range."""
    limit = (EXACT / max(1, a.shape[1])) ** 0.5
    plain_a, plain_x = a_most < limit, x_most < limit
    if plain_a.all() and plain_x.all():
        return (a @ x.T).astype(np.int64)
    out = np.zeros((len(a), len(x)), np.int64)
    out[np.ix_(plain_a, plain_x)] = (a[plain_a] @ x[plain_x].T).astype(np.int64)
    whole = lambda raw: [[floor(Fraction(v) * scale) for v in row] for row in raw.tolist()]
    rows = whole(x_raw[~plain_x])
    for i, anchor in enumerate(whole(a_raw)):
        at = np.flatnonzero(~plain_x) if plain_a[i] else np.arange(len(x))
        for j, row in zip(at, rows if plain_a[i] else whole(x_raw)):
            out[i, j] = max(LEAST, min(MOST, sum(map(int.__mul__, anchor, row))))
    return out


@dataclass
class Best:
    """The ``top`` best rows met: highest score, then smallest id, then smallest key."""

    top: int
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def least(self) -> int:
        """A score that a row must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.top else LEAST

    def add(self, score: np.ndarray, id_: np.ndarray, key: np.ndarray) -> None:
        if len(score) > self.top:
            near = score >= np.partition(score, len(score) - self.top)[len(score) - self.top]
            score, id_, key = score[near], id_[near], key[near]
        s, i, k = (np.concatenate(x) for x in ((self.score, score), (self.id, id_), (self.key, key)))
        first = np.lexsort((k, i, ~s))[: self.top]
        self.score, self.id, self.key = s[first], i[first], k[first]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


FOUND = "anchor long, place int, score long, id long, key long"


def scanned(rows: DataFrame, anchors: dict[int, dict[str, np.ndarray]], labels: list, scale: int, top: int, windows: dict[int, list[tuple[int, int, int]]] | None) -> DataFrame:
    """Of each partition, and for each anchor, the ``top`` rows of its label, or, with windows, of other labels in each.

    anchors: by length, arrays of keys, label numbers and vectors. windows: for each anchor's key, place, lowest and highest score.
    """
    shared = rows.sparkSession.sparkContext.broadcast((anchors, labels, windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names, bounds = shared.value
        asked = {d: a | dict(zip(("q", "most"), quantised(a["x"], scale))) for d, a in asked.items()}
        places = {int(k): bounds[int(k)] if bounds is not None else [(0, LEAST, MOST)] for a in asked.values() for k in a["key"]}
        best = {(k, p): Best(top) for k, held in places.items() for p, *_ in held}
        names = pa.array(names)
        for big in batches:
            for at in range(0, big.num_rows, ROW_BLOCK):
                part = big.slice(at, ROW_BLOCK)
                for d, where in by_length(part["x"]):
                    if d not in asked:
                        continue
                    x, a = matrix(part["x"], where, d), asked[d]
                    key, id_ = (part[c].take(where).to_numpy() for c in ("key", "id"))
                    label = pc.fill_null(pc.index_in(part["label"].take(where), names), -1).to_numpy()
                    q, most = quantised(x, scale)
                    for start in range(0, len(a["key"]), PRODUCT_BLOCK):
                        own = slice(start, start + PRODUCT_BLOCK)
                        score = products(a["q"][own], a["most"][own], q, most, scale, a["x"][own], x)
                        for s, k, mine in zip(score, a["key"][own].tolist(), a["label"][own]):
                            kind = (label == mine) & (key != k) if bounds is None else label != mine
                            for p, low, high in places[k]:
                                b = best[k, p]
                                hit = np.flatnonzero(kind & (s >= max(low, b.least)) & (s <= high))
                                if len(hit):
                                    b.add(s[hit], id_[hit], key[hit])
        held = [(k, p, b) for (k, p), b in best.items() if len(b.score)]
        for i in range(0, len(held), 5000):
            some = held[i : i + 5000]
            sizes = [len(b.score) for *_, b in some]
            cols = [np.repeat(np.array([k for k, *_ in some]), sizes), np.repeat(np.array([p for _, p, _ in some], np.int32), sizes), *(np.concatenate([getattr(b, c) for *_, b in some]) for c in ("score", "id", "key"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "place", "score", "id", "key"])

    return rows.mapInArrow(scan, FOUND)


def merged(found: DataFrame, top: int) -> DataFrame:
    """The best of all partitions, with their rank; a key has at most ``top`` rows from each."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mined(
    spark: SparkSession, vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the whole inner product of the components' floor(scale * x). For each anchor, its ``positives`` nearest
    other rows of its label; for each of these, the ``negatives`` nearest rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's; ties by smaller id. Rows with a null id, label or vector, or a null or non-finite
    component, take no part. A row meets rows of its own length; an empty vector scores 0. Scores beyond a long's range
    count as its ends. Rows are told apart by a number of their own, so repeated rows count each for itself, as anchors,
    positives and negatives. An anchor without positives, or a positive whose window is empty (any below 0), gives no
    row, as does an empty table. Anchors go out in blocks, each with two scans of all rows; a partition passes on a bounded
    number of rows for each anchor, so a common vector or label makes no task large. Other columns are not read.
    """
    x = F.col("x")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = saved(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad).withColumn("key", F.monotonically_increasing_id()), "vectors")
    asking = rows.where("asks").select("key", "id", "label", "x")
    n, longest = asking.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        dropped(rows)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = -(-n // max(1, min(anchor_block, ANCHOR_BYTES // (8 * max(1, longest)))))
    parts = []
    for b in range(blocks):
        block, names, ids = {}, {}, {}
        for r in asking.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toLocalIterator():
            held = block.setdefault(len(r["x"]), {"key": [], "label": [], "x": []})
            held["key"].append(r["key"])
            held["label"].append(names.setdefault(r["label"], len(names)))
            held["x"].append(r["x"])
            ids[r["key"]] = r["id"]
        if not block:
            continue
        arrays = {d: {"key": np.array(h["key"], np.int64), "label": np.array(h["label"]), "x": np.array(h["x"], np.float64).reshape(len(h["x"]), d)} for d, h in block.items()}
        first = merged(scanned(rows, arrays, list(names), scale, positives, None), positives).collect()  # a few for each anchor of the block
        windows = {k: [] for k in ids}
        for r in first:
            windows[r["anchor"]].append((r["rank"], *window(r["score"], low, high)))
        found = merged(scanned(rows, arrays, list(names), scale, negatives, windows), negatives)
        positive = spark.createDataFrame([(r["anchor"], r["rank"], ids[r["anchor"]], r["id"], r["score"]) for r in first], "anchor long, place int, anchor_id long, positive_id long, positive_score long")
        out = found.join(F.broadcast(positive), ["anchor", "place"])
        parts.append(saved(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined"))
    dropped(rows)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return every
