import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from xxhash import xxh64_intdigest
from test_minhash import brute as brute_groups
from test_mixing import WORD, brute as brute_mix

import corpus_pipeline
from granary.llm.quality import judged
from granary.llm.sampling import Lattices, PieceModel, row_keys


def brute(docs):
    """(doc_id, ids) of the whole pipeline, stage by stage in plain Python."""
    clean = []
    for d, text, source in docs:
        n, chars, _, _, again, kept, out = judged(text)
        if n >= 50 and 100 * again <= 50 * n and 100 * kept >= 50 * chars:
            clean.append((d, out, source))
    groups = brute_groups([(d, t) for d, t, _ in clean], 5)
    single = [x for x in clean if groups[x[0]][2]]
    rows = []
    taken = brute_mix(single)
    for d, text, _ in single:
        size, left = taken[d][0], taken[d][3]
        ends = [m.end() for m in WORD.finditer(text)]
        while left > 0:
            rows.append((d, text if left >= size else text[: ends[left - 1]]))
            left -= size
    model = PieceModel(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    seen, copies = Counter(), []
    for row in rows:  # equal rows are numbered
        copies.append(f"{xxh64_intdigest(row[1].encode(), 42):X}:{seen[row]}")
        seen[row] += 1
    tokens, counts = Lattices(model).sample([t for _, t in rows], row_keys([d for d, _ in rows], 29, copies))
    return Counter((d, tuple(x.tolist())) for (d, _), x in zip(rows, np.split(tokens, np.cumsum(counts)[:-1])))


def test_run_is_as_brute_force(spark, tmp_path):
    def word(i):
        return hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 5]

    docs = []
    for i in range(120):
        k = i if i % 4 else i // 8  # copies, some with a changed word
        text = "\n".join(" ".join(word(k * 1000 + j * 20 + x) for x in range(14)) + f" {word(k)}." for j in range(3 + k % 5))
        docs.append((i, text.replace(".", f" {word(i)}.", 1) if i % 8 == 0 else text, [None, "a", "b", "a", "c"][i % 5]))
    docs += [(200, None, "a"), (201, "too short", None), (202, "w | x | y | z\n" * 30, "b"), (203, docs[1][1] + "\nHome | News | Help | Shop", "b")]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path))
    found = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(docs)
    assert found == want and len(want) > 20
    # the epochs of a document are segmented in unlike ways, but for what chance makes equal
    assert max(Counter(d for d, _ in found).values()) > 1 and len(found) > 0.9 * sum(found.values())


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect() == []
