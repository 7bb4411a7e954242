import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import Row

from granary.llm.sharding import first_map, read_map, rebalanced, sharded


def brute(spark, rows, path):
    """Every row by plain Python, given the stored map: slots by hash of id and text, places by order in the shard."""
    stored = dict(read_map(spark, str(path)).select("virtual_slot", "shard").collect())
    found = []
    for d, t, *_ in rows:
        h = 42
        for x in (None if d is None else str(d), t):
            h = h if x is None else xxhash.xxh64_intdigest(x.encode(), h)
        s = (h - 2**64 if h >= 2**63 else h) % 4096
        found.append((stored[s], s, d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1))
    places = Counter()
    for k, s, has, d, crc, size in sorted(found):
        yield Row(doc_id=d if has else None, size=size, text_crc32=crc, virtual_slot=s, shard=k, slot=places[k])
        places[k] += 1


def test_a_stored_map_is_edited_as_its_next_version(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(2_000)], "doc_id long, text string")
    first = sharded(spark, docs, map_path=path).collect()
    again = sharded(spark, docs, map_path=path).collect()
    assert len(again) == 2_000 and sorted(map(str, first)) == sorted(map(str, again))
    versions = lambda: {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()}
    assert versions() == {0, 1}  # nothing to edit, no new version
    grown = docs.unionAll(spark.createDataFrame([(10_000 + i, "y" * 500) for i in range(300)], docs.schema))
    shard = {r["virtual_slot"]: r["shard"] for r in first}
    more = sharded(spark, grown, map_path=path).collect()
    moved = sum(shard.get(s, k) != k for s, k in {(r["virtual_slot"], r["shard"]) for r in more})
    assert len(more) == 2_300 and versions() == {0, 1, 2} and moved < len(shard) / 2
    wider = sharded(spark, grown, shards=17, map_path=path).collect()  # one shard more
    total = Counter()
    for r in wider:
        total[r["shard"]] += r["size"]
    assert len(total) == 17 and max(total.values()) - min(total.values()) < 0.05 * sum(total.values()) / 17
    fewer = sharded(spark, grown, shards=3, map_path=path).collect()
    assert {r["shard"] for r in fewer} == {0, 1, 2} and versions() == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        sharded(spark, docs, slots=8, map_path=path)


def test_shards_are_near_equal_and_slots_gapless(spark, tmp_path):
    rows = [(i, "é" * (i * 37 % 800) if i % 9 else None, "x", i) for i in range(3_000)] + [(None, "null id", "x", 0)] * 3 + [(5, "again", "x", 0)] * 4 + [(9_999, "long " * 40_000, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, size int").repartition(7)
    found = sharded(spark, docs, map_path=str(tmp_path / "map")).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in found) == want
    total = [0] * 16
    for k in range(16):
        mine = [r for r in found if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        total[k] = sum(r["size"] for r in mine)
    assert max(sum(total) / 16 * 1.001, 200_001 + 4_000) >= sorted(total)[-1] and sorted(total)[-2] - min(total) < 0.002 * sum(total)
    by_slot = {}
    for r in found:
        assert by_slot.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    stored = {r["virtual_slot"]: r["shard"] for r in read_map(spark, str(tmp_path / "map")).collect()}
    assert len(stored) == 4096 and by_slot.items() <= stored.items()
    assert {r["shard"] for r in read_map(spark, str(tmp_path / "map"), 0).collect()} == set(range(16))
    again = sharded(spark, docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sorted(map(str, found)) == sorted(map(str, brute(spark, rows, tmp_path / "map")))


def test_one_huge_slot_and_empty_table(spark):
    new = rebalanced(first_map(8, 2), {0: 100, 1: 1, 2: 1, 3: 1}, 2)
    load = [0, 0]
    for s, b in {0: 100, 1: 1, 2: 1, 3: 1}.items():
        load[new[s]] += b
    assert sorted(load) == [3, 100]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharded(spark, docs).collect() == []


def test_a_balanced_map_stays():
    assert rebalanced(first_map(4, 2), {s: 5 for s in range(4)}, 2) == first_map(4, 2)
