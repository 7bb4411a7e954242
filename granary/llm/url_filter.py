"""URL allow and block rules held in a Bloom filter cascade.

Level 0 of a cascade encodes the listed keys; level 1 encodes the keys of the corpus's universe that level 0
wrongly lets through; level 2 the listed keys that level 1 wrongly holds; and so on until a level has no
false positive left. Over that universe membership is then exact, and judging a page needs no join. Very many keys are
parted by hash, with a cascade for each part; the parts' cascades go over the pages in turn.
"""

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType

from granary.llm.common import dropped, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's bitmap functions work on chunks of this many bits.
CHUNK = 32768
#: Keys that one cascade's level is made for, about; more make several parts, each sent to the tasks by itself.
PART_KEYS = 8_000_000
#: Share of keys that a Bloom filter wrongly lets through, at most, with the bits and probes used here.
WRONG = 0.02


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both empty without ``://`` or url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: Iterable[tuple[int, int]]) -> Column:
    """Every key by which a rule could fit, longest first: host suffixes by labels times path prefixes by length.

    shapes: the pairs of labels and path length that rules have.
    """
    known = F.from_json(F.lit(json.dumps([{"n": n, "size": size} for n, size in shapes])), "array<struct<n:int,size:int>>")
    labels = F.size(F.split(host, r"\."))
    fitting = F.filter(known, lambda s: (host != "") & (s["n"] <= labels) & (s["size"] <= F.length(path)))
    found = F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["n"]), F.substring(path, F.lit(1), s["size"])))
    return F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _shifts(depth: int) -> tuple[int, int]:
    """Each level mixes the two hashes in its own way, or keys that collide on one level would on all."""
    return 1 + 13 * depth % 47, 1 + 17 * depth % 43


@dataclass(frozen=True)
class Level:
    depth: int
    bits: int
    probes: int
    data: bytes

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        held, data = np.ones(len(a), bool), np.frombuffer(self.data, np.uint8)
        s, t = _shifts(self.depth)
        ua, ub, mask = a.view(np.uint64), b.view(np.uint64), np.uint64(self.bits - 1)
        first, step = ((ua ^ ub >> np.uint64(s)) & mask).astype(np.int64), ((ub ^ ua >> np.uint64(t)) & mask).astype(np.int64)
        for i in range(self.probes):
            at = (first + step * i) & (self.bits - 1)
            held &= (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return held


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @property
    def size(self) -> int:
        return sum(len(x.data) for x in self.levels)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        member, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for i, level in enumerate(self.levels):
            held = level.holds(a[open_], b[open_])
            if i % 2:
                member[open_[~held]] = True
            open_ = open_[held]
        if len(self.levels) % 2:
            member[open_] = True
        return member


def _positions(depth: int, bits: int, probes: int) -> Column:
    s, t = _shifts(depth)
    first, step = (F.col(x).bitwiseXOR(F.shiftrightunsigned(y, n)).bitwiseAND(F.lit(bits - 1)) for x, y, n in (("a", "b", s), ("b", "a", t)))
    return F.array(*[(first + step * F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(probes)])


def _bits_for(n: int, bits_per_key: int) -> int:
    return max(CHUNK, 1 << ceil(log2(max(1, n) * bits_per_key)))


def _level(keys: DataFrame, depth: int, bits: int, probes: int) -> Level:
    """Sets the keys' bits by distributed bitmap aggregation; the driver gets the finished chunks."""
    at = keys.select(F.explode(_positions(depth, bits, probes)).alias("at"))
    chunks = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("map"))
    data = bytearray(bits // 8)
    for r in chunks.toLocalIterator():
        start = (r["chunk"] - 1) * CHUNK // 8
        data[start : start + CHUNK // 8] = r["map"]
    return Level(depth, bits, probes, bytes(data))


def hashed_keys(keys: DataFrame) -> DataFrame:
    """Distinct pairs of hashes of the column ``key``; null keys are left out."""
    return keys.where(F.col("key").isNotNull()).select(_hashes(F.col("key")).alias("h")).select("h.*").distinct()


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 10, probes: int = 4, max_levels: int = 40) -> Cascade:
    """Exact membership in ``listed`` for every key of ``universe``, both as :func:`hashed_keys`.

    Keys that both lack are false positives at the rate of a Bloom filter.
    """
    encode, others = listed, universe.join(listed, ["a", "b"], "left_anti")
    levels: list[Level] = []
    kept = []
    while True:
        n = encode.count()
        if not n and levels:
            break
        levels.append(_level(encode, len(levels), _bits_for(n, bits_per_key), probes))
        if len(levels) > max_levels:
            raise ValueError("the cascade does not end; its hash pairs collide")
        test = levels[-1]

        def passing(batches, test=test):
            for x in batches:
                yield x.filter(pa.array(test.holds(x["a"].to_numpy(), x["b"].to_numpy())))

        through = saved(others.mapInArrow(passing, others.schema), "through")
        kept.append(through)
        encode, others = through, encode
    dropped(*kept)
    return Cascade(tuple(levels))


ACTIONS = ("allow", "block")


def sent(spark: SparkSession, cascades: dict[str, Cascade]) -> Broadcast:
    """As plain tuples: a worker need not import this module to read them."""
    return spark.sparkContext.broadcast({action: [(x.depth, x.bits, x.probes, x.data) for x in c.levels] for action, c in cascades.items()})


def received(shared: Broadcast) -> dict[str, Cascade]:
    return {action: Cascade(tuple(Level(*x) for x in levels)) for action, levels in shared.value.items()}


def _held(cascades: dict[str, Cascade], part: int, parts: int, x: pa.RecordBatch) -> np.ndarray:
    """For every key of the rows: bit 0 is set if it is an allow key, bit 1 if a block key; other parts' keys have none."""
    a, b = (x[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    out = np.zeros(len(a), np.int8)
    mine = np.flatnonzero(a % parts == part) if parts > 1 else np.arange(len(a))
    for k, action in enumerate(ACTIONS):
        if cascades[action].levels:
            out[mine[cascades[action].holds(a[mine], b[mine])]] |= 1 << k
    return out


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame | list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``, duplicates included.

    ``rules``: a list, or a table of any size with host, path and action (allow or block); rules with a null are left
    out, of equal rules with both actions block holds. The longest fitting rule wins, of equally long ones the first by code points (null rule: none fits); the
    cascade of listed block keys, and for rows in neither list ``default``, give the verdict. Null, empty and malformed
    urls have an empty host and path and fit no rule; long ones are taken whole; an empty table gives no row. Other
    columns of ``pages``, of whatever name, are left alone and not returned. Only the rules' shapes (labels of the
    host, length of the path) and the filters of one part at a time reach the driver.
    """
    if isinstance(rules, list):
        rules = spark.createDataFrame([(r.host, r.path, r.action) for r in rules], "host string, path string, action string")
    shapes = sorted(tuple(r) for r in rules.where("host is not null and path is not null").select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    host, path = host_path(pages[url_col])
    base = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    keyed = base.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = saved(hashed_keys(keyed.select(F.explode("keys").alias("key"))), "keys")
    listed = {action: saved(hashed_keys(rules.where(F.col("action") == action).select(F.concat("host", "path").alias("key"))), "keys") for action in ACTIONS}
    counts = {action: df.count() for action, df in listed.items()}
    parts = ceil(max(1, *counts.values(), WRONG * universe.count()) / PART_KEYS)
    kind = dict(pages.select(id_col).dtypes)[id_col]

    def cascades(part: int) -> dict[str, Cascade]:
        mine = F.pmod("a", F.lit(parts)) == part
        return {action: build_cascade(df.where(mine), universe.where(mine)) if counts[action] else Cascade(()) for action, df in listed.items()}

    rows = keyed.select("id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("a"), F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)).alias("b"))
    for part in range(parts - 1):  # all parts but the last are noted
        rows = _noted(spark, rows, cascades(part), part, parts)
    noted = "held" in rows.columns
    shared = sent(spark, cascades(parts - 1))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            flags = _held(received(shared), parts - 1, parts, x)
            if noted:
                flags |= x["held"].flatten().to_numpy(zero_copy_only=False)
            flat, sizes = x["keys"].flatten(), x["keys"].value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            hit = np.append(np.flatnonzero(flags), len(flat))
            at = hit[np.searchsorted(hit, ends - sizes)]  # the first, so longest, key that is held
            fits = at < ends
            rule = flat.take(pa.array(np.where(fits, at, 0), mask=~fits))
            verdict = np.where(fits, np.where(np.append(flags, 0)[np.where(fits, at, len(flat))] & 2, "block", "allow"), default)
            yield pa.RecordBatch.from_arrays([x["id"], x["host"], x["path"], rule, pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    dropped(universe, *listed.values())
    return rows.mapInArrow(verdicts, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _noted(spark: SparkSession, rows: DataFrame, cascades: dict[str, Cascade], part: int, parts: int) -> DataFrame:
    """``rows`` with what this part's cascades hold of their keys, written down."""
    shared, noted = sent(spark, cascades), "held" in rows.columns

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            flags = _held(received(shared), part, parts, x)
            if noted:
                flags |= x["held"].flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(x["keys"].value_lengths().to_numpy(zero_copy_only=False))])
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flags, pa.int8()))
            yield pa.RecordBatch.from_arrays([*(x[c] for c in names), held], names=[*names, "held"])

    names = ["id", "host", "path", "keys", "a", "b"]
    schema = rows.select(*names).schema.add("held", ArrayType(ByteType()))
    out = saved(rows.mapInArrow(note, schema), "noted")
    if noted:
        dropped(rows)
    shared.destroy()
    return out
