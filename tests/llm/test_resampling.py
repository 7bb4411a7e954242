import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest

from granary.llm.resampling import resampled, text_parts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORD.findall((text or "").translate(FOLD))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed="2024"):
    bucket = lambda g: crc32(g.encode()) % buckets
    held = [(i, *features(text, longest)) for i, text in docs]
    s, t = Counter(bucket(g) for _, gs, _ in held for g in gs), Counter(bucket(g) for text in target for g in features(text, longest)[0])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for i, gs, n in held:
        weight = sum(gain(bucket(g)) for g in gs)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def run(spark, docs, target, **args):
    df = spark.createDataFrame([(*d, 7, "x", 1.5) for d in docs], "doc_id long, text string, rank long, score string, `_0` double").repartition(5)
    aims = spark.createDataFrame([(t, "y") for t in target], "text string, n_words string")
    return sorted((tuple(r) for r in resampled(spark, df, aims, **args).collect()), key=repr)


LONG = " ".join(f"W{i % 77}é,x{i % 13}" for i in range(3000))
DOCS = [(i, " ".join(f"word{(i * j) % 31} Benchmark{j % 5}" for j in range(i % 40))) for i in range(200)]
DOCS += [(900, None), (901, ""), (902, " \n\0\t--"), (None, "null id " * 15), (None, None), (903, LONG), (904, "ÄÖ ÜB\x00er ß_x " * 9), (7, "again and again " * 12), (7, "again and again " * 12)]
TARGET = ["benchmark3 word7 word7", None, "", "Überall x9 w5é"]


@pytest.mark.parametrize(("longest", "block"), [(1, 4 << 20), (3, 4 << 20), (1, 100), (3, 100)])
def test_is_as_brute_force_also_in_parts(spark, longest, block):
    assert run(spark, DOCS, TARGET, longest=longest, block=block) == brute(DOCS, TARGET, longest=longest)


def test_few_buckets_other_seed_and_share(spark):
    assert run(spark, DOCS, TARGET, buckets=7, seed="s", percent=55, least_words=3) == brute(DOCS, TARGET, buckets=7, seed="s", percent=55, least=3)


def test_empty_tables(spark):
    assert run(spark, [], TARGET) == []
    assert run(spark, DOCS, []) == brute(DOCS, [])


def test_one_key_of_many_rows_is_drawn_by_count(spark):
    docs = [(5, "the same words over and over " * 5)] * 300
    out = run(spark, docs, TARGET, percent=10)
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 31)) and out == brute(docs, TARGET)


def test_parts_hold_every_word_once():
    for size in (1, 5, 50):
        parts = list(text_parts(LONG, 3, size))
        assert "".join(p[0] for p in parts) == LONG
        assert [w for p in parts for w in WORD.findall(p[0].translate(FOLD))] == WORD.findall(LONG.translate(FOLD))


def test_carried_columns_come_along(spark):
    df = spark.createDataFrame([(i, "some words here " * 10, [i]) for i in range(30)], "doc_id long, text string, row array<int>")
    out = resampled(spark, df, spark.createDataFrame([("words",)], "text string"), carry=("text", "row")).collect()
    assert all(r["row"]["row"] == [r["doc_id"]] and r["row"]["text"].startswith("some") for r in out) and len(out) == 30
