import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import sentencepiece

from granary.llm import sampling
from granary.llm.sampling import Lattices, PieceModel, decoded, row_keys, sampled, told_apart

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = PieceModel(open(PATH, "rb").read())
TEXTS = [None, "", " ", "Hello world", "  two  spaces \n\nlines\t", "▁ mark ▁▁x▁", "naïve 東京 🎉\x00", "x" * 40_000, "word " * 20_000, "\n", "a▁", "▁", "ends in space ", "same text", "same text"]


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def paths(chunk):
    """Every segmentation into pieces of the vocabulary, with its weight by Zipf's law."""
    if not chunk:
        yield [], 1.0
    for j in range(1, len(chunk) + 1):
        piece = LIBRARY.piece_to_id(chunk[:j])
        if piece != LIBRARY.unk_id():
            for rest, p in paths(chunk[j:]):
                yield [piece, *rest], p / (2 - LIBRARY.get_score(piece))


def test_draws_follow_the_lattice():
    chunk = "▁then"
    every = {tuple(p): w for p, w in paths(chunk)}
    total = sum(every.values())
    n = 40_000
    tokens, counts = Lattices(MODEL).sample(["then"] * n, row_keys(range(n), 1))
    seen = Counter(tuple(x) for x in np.split(tokens, np.cumsum(counts)[:-1]) for x in [x.tolist()])
    assert seen.keys() <= every.keys() and len(every) > 5
    for path, w in every.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * (p / n) ** 0.5 + 1e-4


def test_decoding_is_lossless_and_the_librarys():
    lattices = Lattices(MODEL)
    texts = [t or "" for t in TEXTS]
    tokens, counts = lattices.sample(texts, row_keys(range(len(texts)), 2))
    for text, ids in zip(texts, np.split(tokens, np.cumsum(counts)[:-1])):
        assert decoded(MODEL, ids.tolist()).decode() == text
        if "▁" not in text and text.strip(" "):
            assert LIBRARY.decode(ids.tolist()) == text


def test_rows_hang_on_their_key_alone(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(i, t, "y", 2) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1)] * 2
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces int")
    one, many = (sorted(map(str, sampled(spark, docs.repartition(n), PATH).collect())) for n in (1, 7))
    assert one == many
    found = sampled(spark, docs, PATH).collect()
    texts = dict(enumerate(TEXTS)) | {None: "null id"}
    for r in found:
        assert r["lossless"] and r["n_pieces"] == len(r["ids"]) and r["text_crc32"] == crc32((texts[r["doc_id"]] or "").encode())
        assert r["ids_crc32"] == crc32(np.array(r["ids"], "<u4").tobytes())
    by_id = {r["doc_id"]: r["ids"] for r in found}
    assert by_id[8] != sampled(spark, docs.where("doc_id = 8"), PATH, seed=3).first()["ids"]
    assert sampled(spark, docs.limit(0), PATH).collect() == []


def test_cache_overflow_changes_nothing(monkeypatch):
    texts = [f"word{i} and more {i * i}" for i in range(200)]
    keys = row_keys(range(200), 4)
    whole = Lattices(MODEL).sample(texts, keys)[0].tolist()
    monkeypatch.setattr("granary.llm.sampling.CACHE", 10)
    lattices = Lattices(MODEL)
    parts = [lattices.sample(texts[i : i + 9], keys[i : i + 9])[0].tolist() for i in range(0, 200, 9)]
    assert [x for p in parts for x in p] == whole


def test_weights_do_not_run_out():
    lattices = Lattices(MODEL)
    for text in ("𒀀" * 32, "▁" * 32, "t" * 32, "▁" * 4 + "x" * 32):
        lattices[text]
    lattices.learn()
    upto = lattices.upto.data[: lattices.upto.n]
    assert np.isfinite(upto).all() and (upto > 0).all()


def test_pieces_span_any_place_of_a_long_chunk():
    """Draws follow the lattice beyond the 32nd character too, and a word keeps its space mark behind many spaces."""
    n, lead = 4_000, "x" * 31
    tokens, counts = Lattices(MODEL).sample([lead + "then" + "x" * 300] * n, row_keys(range(n), 1))
    marks = [np.cumsum([0, *(len(MODEL.bytes_of[t]) for t in x)]) for x in np.split(tokens, np.cumsum(counts)[:-1])]
    whole = sum(32 in m and 36 in m and 33 not in m and 34 not in m and 35 not in m for m in marks)
    assert whole > 0 and all(m[-1] == 336 for m in marks)
    far, near = (Lattices(MODEL).sample([text] * n, row_keys(range(n), 3)) for text in ("x" * 600 + "q then", "x" * 6 + "q then"))
    ends = [Counter(x.tolist()[-1] for x in np.split(t, np.cumsum(c)[:-1])) for t, c in (far, near)]
    assert all(abs(ends[0][k] - ends[1][k]) < 6 * (ends[1][k] + 1) ** 0.5 + 6 for k in ends[0] | ends[1])
    bar = LIBRARY.piece_to_id("▁bar")
    tokens, counts = Lattices(MODEL).sample([" " * 8 + "bar"] * n, row_keys(range(n), 5))
    assert bar != LIBRARY.unk_id() and any(x[-1] == bar for x in np.split(tokens, np.cumsum(counts)[:-1]))


def test_long_chunks_have_the_exact_marginals():
    """Shares of the last edges of a long chunk, by the forward sums in exact fractions."""
    from fractions import Fraction

    chunk = "▁" + "then" * 30
    lattices = Lattices(MODEL)
    end = lattices[chunk]
    lattices.learn()
    first, last, piece, weight = MODEL.edges([chunk])
    forward = [Fraction(0)] * len(chunk)
    for e in np.argsort(last, kind="stable"):
        forward[last[e]] += Fraction(float(weight[e])) * (forward[first[e] - 1] if first[e] else 1)
    want = sorted((float(Fraction(float(w)) * (forward[f - 1] if f else 1) / forward[end]) for f, x, w in zip(first, last, weight) if x == end), reverse=True)
    lo = lattices.offset.data[end]
    upto = lattices.upto.data[lo : lattices.upto.n]
    assert np.allclose(upto[:-1], np.cumsum(want)[:-1], atol=1e-6) and len(upto) == len(want)


def test_copies_are_drawn_each_by_itself(spark):
    text = "one two three four five six seven " * 4
    rows = [(1, text)] * 5 + [(1, text[:60])] * 2 + [(2, text)] * 3 + [(None, text)] * 200 + [(3, None)] * 2 + [(4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted(map(str, sampled(spark, docs.repartition(n), PATH, copies=True).collect())) for n in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    found = sampled(spark, docs, PATH, copies=True).collect()
    assert all(r["lossless"] for r in found)
    assert len({tuple(r["ids"]) for r in found if r["doc_id"] is None}) == 200  # so many words make repeats unlikely
    full = [tuple(r["ids"]) for r in found if r["doc_id"] == 1 and r["text_crc32"] == crc32(text.encode())]
    assert len(set(full)) == 5
    assert sampled(spark, docs.limit(0), PATH, copies=True).collect() == []


def test_texts_are_not_shuffled_to_tell_copies_apart(spark, monkeypatch):
    """Copies side by side are numbered where they are; those of several tasks, or groups, have numbers without a gap."""
    rows = [(i // 3, f"text of {i // 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    apart = told_apart(docs)
    assert "Exchange" not in apart._jdf.queryExecution().executedPlan().toString()
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "hex(xxhash64(text)) h").distinct().collect()}
    want = sorted((i, t, f"{hashes[t]}:{n % 3}") for n, (i, t) in enumerate(rows))
    assert sorted(map(tuple, apart.collect())) == want
    assert sorted(map(tuple, told_apart(docs.repartition(7)).collect())) == want
    monkeypatch.setattr(sampling, "GROUP_ROWS", 0)
    odd = spark.createDataFrame([(None, "x")] * 30_000 + [(1, None)] * 2, "id long, text string").repartition(3)
    assert sorted((str(r["id"]), int(r["copy"].split(":")[1])) for r in told_apart(odd).collect()) == [("1", 0), ("1", 1), *(("None", i) for i in range(30_000))]


def test_a_long_word_is_one_lattice():
    """Every path of a 40-character word can be drawn: pieces over what were cuts too."""
    word = "a" + "then" * 20
    tokens, counts = Lattices(MODEL).sample([word] * 2000, row_keys(range(2000), 4))
    seen = {x.tolist().__str__() for x in np.split(tokens, np.cumsum(counts)[:-1])}
    places = set()
    for ids in np.split(tokens, np.cumsum(counts)[:-1]):
        at = -1
        for i in ids.tolist():
            size = len(LIBRARY.id_to_piece(i))
            if at < 32 < at + size:
                places.add(32)
            at += size
    assert 32 in places and len(seen) > 1900
