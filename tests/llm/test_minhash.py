import random
from itertools import combinations

import numpy as np
import pytest

from granary.llm import common, minhash
from granary.llm.common import met, sifted
from granary.llm.minhash import BANDS, GOLD, ROWS, WordHash, components, deduplicated, mixed64, near_duplicates, shingles, super_min_hash


def set_of(text, size):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size=2, percent=80):
    sets = {d: set_of(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        yield " ".join(w)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for n, edits in ((90, 14), (40, 22), (5, 3), (2, 1)):
        texts += family(rng, words, n, edits)
    texts += ["the Same text"] * 50 + ["THE same\tTEXT"] * 9 + [None, None, "", " \n", "one", "ONE", "two", "É", "é", "a b", "a b a b a b", "w1 " * 30_000, "w1 " * 10]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_groups_are_as_brute_force(spark, size):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", d[0]) for d in docs], "doc_id long, text string, id string, component_id long").repartition(6)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, size=size).collect()}
    assert found == brute(docs, size)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "a b c"), (5, None)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, size=2).collect())
    assert rows == [("3", 2, 3, True), ("3", 2, 3, True), ("4", 2, 3, False), ("5", 0, 5, True), ("None", 2, None, True)]
    assert sorted(str(r["doc_id"]) for r in deduplicated(spark, df, size=2).collect()) == ["3", "3", "5", "None"]
    assert near_duplicates(spark, df.limit(0)).collect() == [] == deduplicated(spark, df.limit(0)).collect()


def naive(elements, m):
    """The construction element by element, with a permutation array for each."""
    h = [float("inf")] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            r = mixed64(np.array([e], np.uint64) + np.uint64((j + 1) * GOLD % 2**64))
            u = float(r[0] >> np.uint64(11)) * 2.0**-53
            k = j + int((int(mixed64(r)[0]) >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], j + u)
    return h


def test_super_min_hash_is_the_published_one():
    rng = np.random.default_rng(7)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 60, 500)]
    assert super_min_hash(sets, 24).tolist() == [naive(s, 24) for s in sets]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = super_min_hash([x[:900], x[100:]], BANDS * ROWS)
    assert abs((a == b).mean() - 0.8) < 0.1


def test_shingles_of_odd_texts():
    h = WordHash()
    assert len(shingles(None, 2, h)) == len(shingles(" \x0b", 2, h)) == 0
    assert len(shingles("a", 5, h)) == 1 and (shingles("A B", 5, h) == shingles("a  b", 5, h)).all()
    assert len(shingles("a b a b", 2, h)) == 2 and (shingles("É x", 2, h) != shingles("é x", 2, h)).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i + 1, i) for i in range(0, 60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(70)] + [(1000 + i, 1000) for i in range(300)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


def test_components_of_more_edges_than_one_task_takes(spark, monkeypatch):
    """Forests of several tasks meet by stars; where one task takes all edges its forest is the result, at once."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(0, 90) if i % 30] + [(500 + i, 500) for i in range(1, 60)], "a long, b long").repartition(7)
    saves = []
    put = minhash.saved
    monkeypatch.setattr(minhash, "saved", lambda df, name: saves.append(df.rdd.getNumPartitions()) or put(df, name))
    few = {tuple(r) for r in components(edges).collect()}
    assert saves == [1]
    monkeypatch.setattr(minhash, "TASK_EDGES", 40)
    assert {tuple(r) for r in components(edges).collect()} == few and saves[1] == 4
    assert few == {(i, i - (i - 1) % 30) for i in range(1, 91) if (i - 1) % 30} | {(500 + i, 500) for i in range(1, 60)}


def test_rounds_of_likeliest_partners_end_when_they_link_few(spark, monkeypatch):
    """A round that links next to nothing is followed by the one that compares all that is left; members carry their bucket's size."""
    rounds = []
    cross = minhash._cross_pairs

    def counted(members, percent, best, more=None):
        rounds.append(best)
        assert members.groupBy("key").agg({"n": "max", "*": "count"}).where("`max(n)` <> `count(1)`").isEmpty()
        return cross(members, percent, best, more)

    monkeypatch.setattr(minhash, "_cross_pairs", counted)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, size=2).collect()}
    assert found == brute(docs, 2)
    assert rounds.count(True) < minhash.BEST_ROUNDS and (not rounds or rounds[-1] is False)


def test_sketches_lose_no_link():
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 60, 1000, 1024, 1500, 6000):
        for percent in (80, 50):
            for shared in {n, *(n * x // 100 for x in (30, 65, 78, 88, 90, 95))}:
                pool = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
                told = minhash.may_link(*(np.frombuffer(minhash.sketched(s), np.uint32) for s in (a, b)), len(a), len(b), percent)
                assert told or not minhash.similar(a, b, percent)
    far = [np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(2)]
    assert not minhash.may_link(*(np.frombuffer(minhash.sketched(s), np.uint32) for s in far), 400, 400, 80)


def test_last_round_passes_on_pairs_whose_bytes_agree_in_an_earlier_band(spark):
    """Keys differ in bands 0 to 2 though all bytes agree there; the pair meets in bands 3 and 7 and is passed on once."""
    sketch = minhash.sketched(np.arange(100, dtype=np.uint64))
    sig = bytes(BANDS * ROWS)
    keys = {i: [band if band in (3, 7) else 1000 * i + band for band in range(BANDS)] for i in (1, 2)}
    rows = [(band, band, i, i, sig, keys[i], 100, sketch) for i in (1, 2) for band in (3, 7)]
    members = spark.createDataFrame(rows, "key long, band int, id long, root long, sig binary, keys array<long>, size long, sketch binary")
    assert [tuple(r) for r in minhash._cross_pairs(members, 80, best=False).collect()] == [(1, 2)]
    assert minhash._cross_pairs(members.where("key = 7"), 80, best=False).collect() == []


def test_large_near_copies_are_linked(spark):
    """Sets above the sketches' size, at similarities around the threshold: the whole operator against full sets."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for f in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1500, 2500, 4000]))]
        for edits in (0, 0.02, 0.045, 0.05, 0.055, 0.06):
            w = list(base)
            for at in rng.sample(range(len(w)), int(edits * len(w))):
                w[at] = rng.choice(words)
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, size=2).collect()}
    assert found == brute(docs, 2) and min(n for n, _, _ in found.values()) > minhash.SKETCH


def test_rows_with_one_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " end"), (3, b + " end"), (9, "c"), (9, "c"), (9, None), (None, a), (None, None)]
    for n in (1, 4):
        found = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(n), size=2).collect()
        assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in found if r["doc_id"]) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True), (9, 9, True)]
        assert sum(r["doc_id"] is None and r["kept"] for r in found) == 2


def test_names_that_the_operator_uses_itself(spark):
    names = ["gone", "_gone", "gone_", "doc", "kept", "digest", "keys", "id", "a", "b"]
    df = spark.createDataFrame([(i, "one two three four five six", *[str(i)] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = deduplicated(spark, df)
    assert out.columns == df.columns and [r["gone"] for r in out.collect()] == ["0"]


@pytest.mark.parametrize("hot_rows", [0, 3])
def test_groups_do_not_hang_on_what_counts_as_hot(spark, monkeypatch, hot_rows):
    """Keys met by a shuffle, by sending their facts out, or some by either: the same groups."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, size=2).collect()}
    assert found == brute(docs, 2)


def test_met_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 5 + [3] * 6 + [4, None, None])], "k long, at long")
    facts = spark.createDataFrame([(1, 40, "a"), (2, 5, "b"), (3, 6, "c"), (9, 70, "d")], "k long, n long, fact string")
    for how in ("inner", "left"):
        expected = sorted(map(str, rows.join(facts, "k", how).collect()))
        assert sorted(map(str, met(rows, facts, "k", 54, how).collect())) == expected
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    assert met(rows, facts, "k", 54).count() == 51 and met(rows.limit(0), facts, "k", 0).count() == 0


def test_parts_of_a_bucket_meet_through_their_hubs(spark):
    """Every member is in a pair with its part's hub or is that hub; hubs all meet one of them; no pair is of one group."""
    members = spark.createDataFrame([(7, i, i % 50) for i in range(3_000)] + [(8, 5, 5), (8, 6, 6)], "key long, id long, root long")
    pairs = [tuple(r) for r in minhash._hub_pairs(members, 0).collect()]
    assert len(pairs) == len(set(pairs)) <= 3_000 + 8 and all(a % 50 != b % 50 for a, b in pairs)
    large = max(sum(a == hub for a, _ in pairs) for hub in {a for a, _ in pairs})
    assert large < 3_000 / 3 and {(5, 6), (6, 5)} & set(pairs)


def test_pairs_of_a_hub_are_verified_in_parts(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join([*base[: 100 - i % 30], *(f"x{i}_{j}" for j in range(i % 30))])) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(3, 2), (150, 0)], "a long, b long")
    sets = {i: set_of(t, 2) for i, t in texts}
    expected = sorted((r["a"], r["b"]) for r in pairs.collect() if 100 * len(sets[r["a"]] & sets[r["b"]]) >= 80 * len(sets[r["a"]] | sets[r["b"]]))
    assert sorted(tuple(r) for r in minhash.linked(pairs, df, 2, 80).collect()) == expected
    assert minhash.linked(pairs.limit(0), df, 2, 80).collect() == []


def shuffled(spark):
    """Bytes that stages have written for shuffles so far."""
    context, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_meet_none_and_rows_that_stay_are_not_shuffled(spark):
    """Rows are large, few of them meet others and one goes: near-duplicates without a shuffle of the rest."""
    rng = random.Random(12)
    docs = [(i, " ".join(f"{rng.getrandbits(48):012x}" for _ in range(3_000))) for i in range(60)]
    docs.append((60, docs[7][1] + " end"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    given = minhash.saved(df, "docs")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        before = shuffled(spark)
        found = sorted(r["doc_id"] for r in deduplicated(spark, given).collect())
        moved = shuffled(spark) - before
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        minhash.dropped(given)
    assert found == list(range(60))
    assert moved < 0.5 * sum(len(t) for _, t in docs)


@pytest.mark.parametrize("most_bits", [2**27, 2**15])
def test_sifted_keys_pass_and_rows_are_parted(spark, monkeypatch, most_bits):
    """With bits for every key few others pass, with too few bits more do; no row with a key is lost, none is in both parts."""
    monkeypatch.setattr(common, "MOST_BITS", most_bits)
    rows = spark.createDataFrame([(i if i % 10 else None, f"t{i}", i) for i in range(20_000)], "k long, t string, at long")
    keys = rows.where("k % 7 = 1").select("k", "t")
    maybe, no, _ = sifted(rows, [rows["k"], rows["t"]], keys)
    passed, wanted = {r["at"] for r in maybe.collect()}, {i for i in range(20_000) if i % 10 and i % 7 == 1}
    assert wanted <= passed and len(passed - wanted) < (1_000 if most_bits > 2**15 else 5_000) and maybe.columns == no.columns == rows.columns
    assert sorted([*passed, *(r["at"] for r in no.collect())]) == list(range(20_000))
    maybe, no, _ = sifted(rows, [rows["k"], rows["t"]], keys.limit(0))
    assert maybe.count() == 0 and no.count() == 20_000


def test_groups_do_not_hang_on_how_many_rows_are_sifted_out(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", 3)
    monkeypatch.setattr(common, "ROW_BITS", 1)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in deduplicated(spark, df, size=2).collect())
    assert kept == sorted(d for d, (_, _, stays) in brute(docs, 2).items() if stays)
