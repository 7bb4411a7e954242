"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map.

A row's slot is a hash of its id and text and never changes. Bytes are added up for each slot; the map sends slots to
shards. A stored map is read, edited slot by slot until the shards' bytes are near equal, and stored as its next
version, so that later runs move few slots. Rows need no shuffle to find their shard. Law: ``bytes``.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import dropped, exists, new_folder, running_sums, saved

#: Rows of the map, whatever the input; what the driver holds is bounded by it.
SLOTS = 4096


def slot_of(id_col: Column, text: Column, slots: int) -> Column:
    """Hash of id and text: rows of one id, or without one, share a slot only if their texts are equal too."""
    return F.pmod(F.xxhash64(id_col.cast("string"), text), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(slot_map: list[int], slot_bytes: dict[int, int], shards: int) -> list[int]:
    """An edited map: overfull shards give up slots, largest first, which the emptiest shards take; then single
    moves and swaps between the fullest and the emptiest shard go on while they narrow the two."""
    # slots of shards that are no more are dealt round, as in a first map; the heavy ones among them move on below
    new, load = [k if k < shards else s % shards for s, k in enumerate(slot_map)], [0] * shards
    for s, b in slot_bytes.items():
        load[new[s]] += b
    mean = sum(load) / shards
    owned = [[] for _ in range(shards)]
    for s, b in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        owned[new[s]].append(s)
    loose = []
    for k in range(shards):
        for s in list(owned[k]):
            if load[k] > mean and load[k] - slot_bytes[s] >= 0 and len(owned[k]) > 1:
                owned[k].remove(s)
                load[k] -= slot_bytes[s]
                loose.append(s)
    for s in sorted(loose, key=lambda s: (-slot_bytes[s], s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        new[s], load[k] = k, load[k] + slot_bytes[s]
        owned[k].append(s)
    for _ in range(8 * shards):
        hi, lo = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap, best = load[hi] - load[lo], None
        takes = [(None, 0), *((s, slot_bytes[s]) for s in owned[lo])]
        for s in owned[hi]:
            for t, b in takes:
                left = abs(gap - 2 * (slot_bytes[s] - b))
                if 0 < slot_bytes[s] - b < gap and (best is None or left < best[0]):
                    best = (left, s, t)
        if best is None:
            break
        for s, old, to in ((best[1], hi, lo), (best[2], lo, hi)):
            if s is not None:
                owned[old].remove(s)
                owned[to].append(s)
                new[s], load[old], load[to] = to, load[old] - slot_bytes[s], load[to] + slot_bytes[s]
    return new


def stored_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Adds a version to the map stored at ``path``: version, virtual_slot, shard."""
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(slot_map)), "array<int>")).alias("virtual_slot", "shard"))
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, by default the latest that is whole: one whose writing broke off is passed over."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        counts = {r["version"]: r["n"] for r in every.groupBy("version").agg(F.count("*").alias("n")).collect()}
        version = max(v for v, n in counts.items() if n == counts[min(counts)])
    return every.where(F.col("version") == version)


def next_map(spark: SparkSession, path: str, slot_bytes: dict[int, int], shards: int, slots: int) -> list[int]:
    """The map at ``path`` edited for these bytes and stored as its next version, if the edit changes it."""
    if exists(spark, path):
        held = sorted((r["virtual_slot"], r["shard"], r["version"]) for r in read_map(spark, path).collect())
        if len(held) != slots:
            raise ValueError(f"the stored map has {len(held)} slots, not {slots}")
        before, version = [k for _, k, _ in held], held[0][2]
    else:
        before, version = first_map(slots, shards), 0
        stored_map(spark, path, version, before)
    after = rebalanced(before, slot_bytes, shards)
    if after != before:
        stored_map(spark, path, version + 1, after)
    return after


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, virtual_slot, shard, slot for every row of ``docs``.

    ``slot`` is the row's place in its shard, gapless from 0: rows stand by virtual slot, then id. Null texts are
    empty, texts count whole; rows with a null id are dealt by text; repeated rows share a virtual slot, and are
    numbered over several tasks. An empty table gives no row. Other columns, whatever their names, are not read. The map at
    ``map_path`` (default: a new one in the shared folder, dealt round) is edited and stored as :func:`next_map` says.
    """
    text = docs[text_col]
    rows = saved(
        docs.select(
            docs[id_col].alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            slot_of(docs[id_col], text, slots).alias("virtual_slot"), F.lit(1).cast("long").alias("one"),
        ),
        "slots",
    )
    totals = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    slot_map = next_map(spark, map_path or new_folder(spark, "slot-map"), {s: b for s, (b, _) in totals.items()}, shards, slots)
    starts, filled = [0] * slots, [0] * shards
    for s in range(slots):
        starts[s], filled[slot_map[s]] = filled[slot_map[s]], filled[slot_map[s]] + totals.get(s, (0, 0))[1]
    pairs = F.from_json(F.lit(json.dumps(list(zip(slot_map, starts)))), "array<array<bigint>>")
    table = spark.range(1).select(F.posexplode(pairs).alias("s", "x")).select("s", F.col("x")[0].cast("int").alias("shard"), F.col("x")[1].alias("start"))
    placed = running_sums(rows, "virtual_slot", ["id", "text_crc32", "size"], "one", "place")
    out = placed.join(F.broadcast(table), placed["virtual_slot"] == F.col("s"))
    out = saved(out.select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot")), "sharded")
    dropped(rows)
    return out
