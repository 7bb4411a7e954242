import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.packing import Available, best_fit, packed, plan, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def total(planned):
    out = Counter()
    for uses, copies in planned:
        assert copies > 0 and all(n > 0 for n in uses.values())
        for length, n in uses.items():
            out[length] += n * copies
    return {k: n for k, n in out.items() if n}


def one_by_one(counts, capacity):
    """Best fit, longest first, a piece at a time: the gaps left."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            gap = min(fits) if fits else capacity
            if fits:
                gaps.remove(gap)
            gaps.append(gap - length)
    return sorted(gaps)


@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan_holds_all_pieces_and_best_fit_is_as_one_by_one(counts):
    wanted = {k: n for k, n in counts.items() if n}
    planned, fitted = plan(counts, 30), best_fit(counts, 30)
    assert total(planned) == total(fitted) == wanted
    assert all(sum(k * n for k, n in uses.items()) <= 30 for uses, _ in planned + fitted)
    assert sorted(30 - sum(k * n for k, n in uses.items()) for uses, copies in fitted for _ in range(copies)) == one_by_one(counts, 30)
    assert sum(c for _, c in planned) >= -(-sum(k * n for k, n in wanted.items()) // 30)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=12), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_complement_is_found_if_there_is_one(counts, gap):
    pieces = [k for k, n in counts.items() for _ in range(n)]
    sums = set(pieces) | {pieces[i] + pieces[j] for i in range(len(pieces)) for j in range(i)} | {pieces[i] + pieces[j] + pieces[k] for i in range(len(pieces)) for j in range(i) for k in range(j)}
    have = Available(counts, 40)
    found = have.complement(gap)
    assert (found is not None) == (gap in sums)
    assert found is None or sum(found) == gap and not Counter(found) - Counter(pieces)
    assert have.left == Counter(counts)


def test_plan_is_near_the_bound_and_doesnt_grow_with_counts():
    rng = random.Random(5)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(30_000))
    planned = plan(counts, 2048)
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(c for _, c in planned) <= 1.001 * least + 1
    many = plan({k: n * 1_000_000 for k, n in counts.items()}, 2048)
    assert len(many) < 4 * 2048 and sum(c for _, c in many) <= 1.001 * 1_000_000 * least + 1


def test_long_pieces_alone_and_short_ones_in_one():
    assert plan({2048: 7}, 2048) == [({2048: 7 // 7}, 7)] and sum(c for _, c in plan({1: 5000}, 2048)) == 3
    assert sum(c for _, c in plan({1500: 10, 548: 4, 274: 12}, 2048)) == 10


TEXTS = [(i, " ".join(f"word{i * j % 97}" for j in range(i * 7 % 90))) for i in range(150)]
TEXTS += [(500, None), (501, ""), (502, " \n"), (None, "no id here"), (None, None), (503, "long text, " * 2500), (504, "ends <|endoftext|> here"), (7, "twice"), (7, "twice")] + [(600, "hot key " * 9)] * 100


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", [2]) for r in rows], "doc_id long, text string, piece int, kind string, `row` array<int>").repartition(5)


@pytest.mark.parametrize("capacity", [2048, 50])
def test_is_lossless_gapless_and_full(spark, tmp_path, capacity):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    path = f"file://{tmp_path}/packed"
    rows = packed(spark, frame(spark, TEXTS), PATH, path, capacity=capacity).collect()
    wanted = Counter()
    for i, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted[i, n, at, len(part), crc32(np.array(part, "<u4"))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for held in by_sequence.values():
        upto = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == upto
            upto += r["length"]
        assert upto <= capacity
    assert len(by_sequence) <= len(one_by_one(Counter(r["length"] for r in rows), capacity))
    whole = {r["sequence_id"]: r for r in sequences(spark, path).collect()}
    assert set(whole) == set(by_sequence)
    for s, held in by_sequence.items():
        ids = np.array(whole[s]["ids"], "<u4")
        assert whole[s]["n_ids"] == len(ids) == sum(whole[s]["lengths"])
        assert all(crc32(ids[r["offset"] : r["offset"] + r["length"]]) == r["ids_crc32"] for r in held)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/packed"
    assert packed(spark, frame(spark, []), PATH, path).collect() == [] and sequences(spark, path).collect() == []
