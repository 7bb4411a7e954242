import re

import pytest

from granary.llm.quality import cleaned, judged, line_fault, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
def prose(n):
    return "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(n))


PROSE = "Plain sentences follow each other here, with words that differ and a stop at the end of line number {}."


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    again = set()
    for i in range(len(w) - 2):
        if any(w[i : i + 3] == w[j : j + 3] for j in range(len(w) - 2) if i != j):
            again |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


TEXTS = [None, "", " \n\t", "a b c a b c a b", "x x x x", "l 1\nl 1\n\nl 1 \n|#<\n", "é\x85ü\xa0b\x1cc d\x0be f", "\n".join(PROSE.format(i) for i in range(9)), "a b a b a b c", "same line\n" * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_figures_are_as_brute_force(text):
    assert judged(text)[:5] == brute(text)


def test_line_rules():
    assert line_fault("Home | About | Contact | Help", False) == "navigation"
    assert line_fault("Some%%% words*** have### noise&&& here$$$", False) == "symbols"
    assert line_fault("BUY NOW OR YOU WILL MISS OUT", False) == "shouting"
    assert line_fault("An ordinary line.", True) == "repeated"
    assert line_fault("All Rights Reserved.", False) == "boilerplate"
    assert line_fault("so " * 20 + "on", False) == "punctuation"
    for good in ("A heading", "NASA said so.", "An open heading: with, commas", "5 < 6 and 7 > 6, as anyone knows.", "Das Maß ist voll; " * 8, "It ends in a quote, “as it should.”", "- a list entry of few words"):
        assert line_fault(good, False) is None


def test_documents_that_lose_too_much_go(spark):
    good, menu = prose(6), "\n".join(f"w{i} | x{i} | y{i} | z{i} | v{i}" for i in range(60))
    rows = [(1, good, 0, "a"), (2, menu, 0, "b"), (3, f"{good}\nHome | About | Contact | Help", 0, None), (4, None, None, None), (None, good, 1, "a"), (6, good * 3_000, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string").repartition(3)
    found = {r["doc_id"]: r for r in quality(docs).collect()}
    assert {k: (r["base_failed"], r["kept"]) for k, r in found.items()} == {1: (False, True), 2: (False, False), 3: (False, True), 4: (True, False), None: (False, True), 6: (True, False)}
    out = {r["doc_id"]: r for r in cleaned(docs).collect()}
    assert out.keys() == {1, 3, None} and out[3]["text"] == good and out[3]["n_chars"] == len(good) and cleaned(docs).columns == docs.columns
    assert quality(docs.limit(0)).collect() == [] == cleaned(docs.limit(0)).collect()


def test_names_that_the_operator_uses_itself(spark):
    names = ["_clean", "clean", "kept", "_kept", "passes", "judged", "n_words"]
    text = " ".join(f"word{i}" for i in range(80)) + "."
    df = spark.createDataFrame([(i, text, *[str(i)] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = cleaned(df)
    assert out.columns == df.columns and all(r[n] == str(r["doc_id"]) for r in out.collect() for n in names) and out.count() == 3
    assert cleaned(df.limit(0)).collect() == []
