import hashlib
import re
from collections import defaultdict

import pytest

from granary.llm.mixing import mix_documents, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, weights=(5, 2, 1), cap=3, seed=17):
    """doc_id -> (size, source_size, target, taken)."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    by = defaultdict(list)
    for d, _, s in docs:
        by[s].append(d)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = {s: sum(size[d] for d in by[s]) for s in order}
    left, free, target = sum(total.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * total[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            free.discard(s)
    out = {}
    for s in order:
        budget = int(target[s] + 0.5)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for d in sorted(by[s], key=lambda d: (hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d)):
            part = min(max(rest, 0), size[d])
            rest -= size[d]
            out[d] = (size[d], total[s], target[s], epochs * size[d] + part)
    return out


DOCS = [(i, " ".join(["wörd"] * (i * 7 % 40)) if i % 11 else None, ["b", "a", None, "Z", "é"][i * i % 5] if i % 3 else "a") for i in range(400)]


def frame(spark, docs):
    return spark.createDataFrame([(*d, 9, "x") for d in docs], "doc_id long, text string, source string, size int, target string")


def test_mixture_is_as_brute_force(spark):
    found = {r["doc_id"]: (r["_size"], r["_source_size"], r["_target"], r["_taken"]) for r in mixed(spark, frame(spark, DOCS).repartition(5)).collect()}
    want = brute(DOCS)
    assert found.keys() == want.keys()
    for d, x in want.items():
        assert found[d][:2] == x[:2] and found[d][3] == x[3] and found[d][2] == pytest.approx(x[2])
        assert found[d][3] <= 3 * found[d][0]


def test_sources_without_words_one_source_and_empty_table(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \n", None)]
    assert {r["_taken"] for r in mixed(spark, frame(spark, docs)).collect()} == {0}
    docs = [(1, "a b", "s"), (2, "c", "s")]
    assert {r["doc_id"]: r["_taken"] for r in mixed(spark, frame(spark, docs)).collect()} == {1: 2, 2: 1}
    assert mixed(spark, frame(spark, []), keep=["doc_id"]).collect() == []


def test_null_ids_and_repeated_rows_keep_the_budget(spark):
    docs = [(None, "a b c", "s")] * 5 + [(7, "d e", "s")] * 3 + [(8, "f " * 90, "t")]
    rows = mixed(spark, frame(spark, docs)).collect()
    assert len(rows) == 9
    assert sum(r["_taken"] for r in rows if r["_source_size"] == 21) == 63  # three times its words at most
    assert all(r["_taken"] <= 3 * r["_size"] for r in rows)


def test_mixture_itself_holds_the_taken_words(spark):
    docs = [(d, t, s) for d, t, s in DOCS if d < 120]
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mix_documents(spark, df).collect()
    words = defaultdict(int)
    texts = {d: t for d, t, _ in docs}
    for r in rows:
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert dict(words) == {d: x[3] for d, x in brute(docs).items() if x[3]}


def test_names_that_the_operator_uses_itself(spark):
    names = ["_size", "size", "_taken", "kept", "taken", "epoch", "whole", "key", "_source", "_key", "_at", "_range", "cut"]
    df = spark.createDataFrame([(i, "a b c", "s", *[str(i)] * len(names)) for i in range(4)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mix_documents(spark, df)
    assert out.columns == df.columns and all(r[n] == str(r["doc_id"]) for r in out.collect() for n in names)
    assert mixed(spark, df, keep=["doc_id", "_size"]).columns == ["doc_id", "_size", "_size_", "_source_size", "_target", "_taken"]


def test_many_rows_without_id_are_cut_exactly(spark):
    docs = [(None, "a b c d e", "s")] * 300 + [(None, f"w{i}", "s") for i in range(50)] + [(1, "x " * 20_000, "t")]
    for n in (1, 7):
        rows = mixed(spark, frame(spark, docs).repartition(n), weights=(1.0, 40.0)).collect()
        source = [r for r in rows if r["_source_size"] == 1550]
        assert sum(r["_taken"] for r in source) == round(source[0]["_target"]) and all(r["_taken"] <= 3 * r["_size"] for r in source)
