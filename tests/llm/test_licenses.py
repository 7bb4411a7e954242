import re
from collections import Counter
from math import sqrt

from pyspark.sql import functions as F

from granary.llm.licenses import TEMPLATES, TEXT_THRESHOLD, THRESHOLD, anchors, any_of, core, idf_of, licence_texts, scanned, text_weights, tokens

MIT, APACHE, GPL = TEMPLATES[2][1], TEMPLATES[0][1], TEMPLATES[4][1]
FILES = [
    ("repo/LICENSE", MIT + "\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the Software), to deal in the Software without restriction"),
    ("repo/a.c", "int main() {}"), ("repo/sub/deep/b.c", f"// {APACHE}\ncode of the word and the under " + "more code " * 9), ("repo/sub/deep/c.c", None), ("repo/sub/COPYING", GPL), ("repo/sub/deep/d.c", ""), ("other/x.c", "plain words of a text"),
    ("top.txt", "nothing to see"), (None, APACHE), ("/abs/LICENSE.md", "ALL RIGHTS  RESERVED"), ("/abs/y/z", "x"), ("notes/n.txt", f"{APACHE} {'filler words go here ' * 20}"), ("two/t.txt", f"{MIT}\n{MIT}\n{GPL}\nshort"), ("two/u.txt", "u"),
    ("long/l.txt", "word " * 60_000 + "\n" + GPL),
]


def says_so(text, name):
    text = " ".join(text.lower().replace(",", "").split())
    versions = {"Apache-2.0": "apache license version 2.0", "GPL-3.0": "gnu general public license version 3", "GPL-2.0": "gnu general public license version 2"}
    return versions[name] in text if name in versions else not name.startswith(("LGPL", "AGPL", "MPL", "BSL", "CC-BY"))


def brute(files):
    n = len(files)
    df = Counter(t for _, text in files for t in set(tokens(text or "")))
    vocabulary = {t for _, text in [*TEMPLATES, ("", "spdx identifier " + " ".join(name for name, _ in [*TEMPLATES, *licence_texts()]))] for t in tokens(text)}
    idf = lambda t: idf_of(df[t] if t in vocabulary else 0, n)

    def vector(text):
        return {t: c * idf(t) for t, c in Counter(tokens(text)).items()}

    def cos(a, b):
        return sum(w * b.get(t, 0) for t, w in a.items()) / sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    own, is_file, found = {}, {}, {}
    for i, (path, text) in enumerate(files):
        hits = {}
        for s in set((text or "").split("\n")) | {p for p in __import__("re").split(r"\n\s*\n", text or "") if "\n" in p}:
            if tokens(s):
                # of the names in this fixture, those with versions stand in what they fit
                best = max((round(cos(vector(s), vector(t)), 6), -k, name) for k, (name, t) in enumerate(TEMPLATES) if says_so(s, name))
                if best[0] >= THRESHOLD:
                    hits[s] = best
        own[i], found[i] = max(hits.values(), default=None), sorted({h[2] for h in hits.values()})
        words = sum(len(x.split()) for x in (text or "").split("\n") if x in hits)
        names = (path or "").rsplit("/", 1)[-1].lower()
        is_file[i] = bool(own[i] and path and (names.startswith(("license", "copying")) or 100 * words >= 50 * len((text or "").split())))
    says = {}
    for i, (path, _) in enumerate(files):
        if is_file[i]:
            d = path.rpartition("/")[0]
            says[d] = max(says.get(d, (0,)), own[i])
    out = {}
    for i, (path, _) in enumerate(files):
        license, source = own[i] and own[i][2], own[i] and "own"
        d = path and path.rpartition("/")[0]
        while not own[i] and path and not license:
            if d in says:
                license, source = says[d][2], f"dir:{d}"
            if not d:
                break
            d = d.rpartition("/")[0]
        out[i] = (own[i] and own[i][2], own[i] and own[i][0], is_file[i], license, source, found[i])
    return out


def test_scan_is_as_brute_force(spark):
    rows = [(i, p, t, "x", 1.0) for i, (p, t) in enumerate(FILES)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string, license string, score double").repartition(4)
    found = {r["doc_id"]: (r["own_license"], r["own_score"], r["is_licence_file"], r["license"], r["license_from"], r["found"]) for r in scanned(spark, df, F.col("p")).collect()}
    want = brute(FILES)
    assert {k: v[:1] + v[2:] for k, v in found.items()} == {k: v[:1] + v[2:] for k, v in want.items()}
    assert all(v[1] is None and want[k][1] is None or abs(v[1] - want[k][1]) < 2e-6 for k, v in found.items())
    assert want[1][3:5] == ("MIT", "dir:repo") and want[3][3:5] == ("GPL-3.0", "dir:repo/sub") and want[6][3] is None and want[10][3] == "Proprietary" and want[11][0] is None


def test_empty_table_null_ids_and_ties(spark):
    df = spark.createDataFrame([(None, "a/LICENSE", MIT), (1, "b/LICENSE", MIT), (2, "b/COPYING", APACHE), (3, "b/c", None)], "doc_id long, p string, text string")
    found = {r["doc_id"]: r["license"] for r in scanned(spark, df, F.col("p")).collect()}
    assert found == {None: None, 1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0"}
    assert scanned(spark, df.limit(0), F.col("p")).collect() == []


GNU = "{} is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version."
HEADERS = [
    (GNU.format("This program", "", "2"), "GPL-2.0"), (GNU.format("This program", "", "3"), "GPL-3.0"), (GNU.format("This library", "Lesser ", "2.1"), "LGPL-2.1"), (GNU.format("This library", "Lesser ", "3"), "LGPL-3.0"),
    (GNU.format("This program", "Affero ", "3"), "AGPL-3.0"), (GNU.format("This library", "Library ", "2"), None), (GNU.format("This program", "", "1"), None), (GNU.format("This program", "Affero ", "1"), None),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This work is licensed under the GNU General Public License.", None),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/1.1/.", None),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.', "Apache-2.0"), ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Apache License.", "Apache-2.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 3.0.", None), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Released under the MIT License.", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("# SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("SPDX-License-Identifier: MIT-0", None), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: GPL-1.0-only", None), ("SPDX-License-Identifier: EUPL-1.2", None), ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", "CC0-1.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Zlib"),
]


def test_standard_headers_and_tags_have_their_own_name_or_none(spark):
    """Among 3,000 documents of other words, so that words weigh as in a corpus; each shipped name is met."""
    rng = __import__("random").Random(4)
    common = "the of and to in is it this that under be for with work may not any or by as you file".split()
    rows = [(1000 + i, f"prose/{i}", " ".join(rng.choices([*common, *(f"w{k}" for k in range(400))], k=60))) for i in range(3000)]
    rows += [(i, f"p{i}/a.c", f"/* Some file\n\n{text}\n\n */\nint main() {{}}") for i, (text, _) in enumerate(HEADERS)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").repartition(4)
    found = {r["doc_id"]: r["own_license"] for r in scanned(spark, df, F.col("p")).where("doc_id < 1000").collect()}
    assert {i: found[i] for i in range(len(HEADERS))} == {i: name for i, (_, name) in enumerate(HEADERS)}
    for name, text in licence_texts():
        assert name in {n for _, n in HEADERS} | {"Artistic-1.0-Perl"}


def test_a_text_like_a_licence_with_another_title_has_not_its_name(spark):
    gpl = dict(licence_texts())["GPL-3.0"]
    affero = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1).replace("GNU General Public License", "GNU Affero General Public License")
    df = spark.createDataFrame([(1, "a/COPYING", gpl), (2, "b/COPYING", affero), (3, "c/x", "plain words")], "doc_id long, p string, text string")
    found = {r["doc_id"]: (r["own_license"], r["own_score"]) for r in scanned(spark, df, F.col("p")).collect()}
    assert found[1][0] == "GPL-3.0" and found[2][0] == "AGPL-3.0"


def test_pattern_of_words_matches_these_alone():
    words = ["a", "ab", "abc", "bd", "b.d", "2.0", "2", "zz"]
    for w in [*words, "", "abcd", "b", "bxd", "2.", "20", "z", "c"]:
        assert bool(re.fullmatch(any_of(words), w)) == (w in words), w


def test_anchors_lose_no_match():
    weights = {"the": 1.0, "license": 3.0, "mit": 5.0}
    assert anchors(weights, 0.7) == {"mit"} and anchors(weights, 0.2) == {"license", "mit"}


def test_words_of_no_template_weigh_by_all_documents(spark):
    """A common word beside a notice costs it no more at many rows than at few; scores are those of true frequencies."""
    notice = "This was released under the MIT License."
    for n in (20, 2000):
        files = [(i, "d/x", "it was so") for i in range(n)] + [(n, "e/y", notice)]
        df = Counter(t for *_, text in files for t in set(tokens(text)))
        a, b = ({t: idf_of(df[t], len(files)) for t in tokens(text)} for text in (notice, MIT))
        want = sum(w * b.get(t, 0) for t, w in a.items()) / sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        found = {r["doc_id"]: (r["own_license"], r["own_score"]) for r in scanned(spark, spark.createDataFrame(files, "doc_id long, p string, text string"), F.col("p")).collect()}
        assert found[n][0] == "MIT" and abs(found[n][1] - want) < 2e-6 and all(found[i][0] is None for i in range(n))


def test_whole_licences_are_known_by_their_text(spark):
    texts = dict(licence_texts())
    rng = __import__("random").Random(6)
    words = sorted({w for t in texts.values() for w in tokens(t)})
    files = []
    for name, text in texts.items():
        lines = text.split("\n")
        edited = [x for x in lines if rng.random() > 0.04]
        edited.insert(3, "Copyright 1999 The Somebody Project of Nowhere")
        files += [(f"{name}/LICENSE", "\n".join(edited)), (f"{name}/src/a.c", "int main() {}"), (f"{name}/part", "\n".join(lines[: len(lines) // 4]) + " of something else " * 300)]
    files += [(f"prose/{i}", " ".join(rng.choice(words) for _ in range(rng.randint(5, 900)))) for i in range(300)]
    files.append(("twice/COPYING", texts["MIT"] + "\n" + texts["MIT"]))
    rows = [(i, p, t) for i, (p, t) in enumerate(files)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").repartition(4)
    found = {r["doc_id"]: r for r in scanned(spark, df, F.col("p")).collect()}
    n = len(files)
    held = Counter(t for _, text in files for t in set(tokens(text)))
    weights = {name: text_weights(text, held, n) for name, text in texts.items()}
    known = 0
    for i, (path, text) in enumerate(files):
        mine, best = text_weights(text, held, n), {}
        for name, w in weights.items():
            both = sqrt(sum(x * x for x in w.values()) * sum(x * x for x in mine.values()))
            best[name] = round(sum(x * w.get(t, 0) for t, x in mine.items()) / both, 6) if both else 0
        near = max(best.values())
        if abs(near - TEXT_THRESHOLD) > 1e-5 and near >= TEXT_THRESHOLD:
            known += 1
            assert found[i]["is_licence_file"] and max(best, key=best.get) in found[i]["found"] and found[i]["own_score"] >= near - 2e-6
        elif near < TEXT_THRESHOLD - 1e-5 and path.startswith("prose"):
            assert found[i]["own_license"] is None
    assert known >= len(texts)
    for k, name in enumerate(texts):
        assert found[3 * k]["is_licence_file"] and found[3 * k + 1]["license"] == found[3 * k]["own_license"]
    assert sum(found[3 * k]["own_license"] == name for k, name in enumerate(texts)) >= len(texts) - 1


def test_core_terms_bound_the_cosine():
    """A text with fewer core terms than asked for can't reach the threshold, whatever else of the licence it holds."""
    for name, text in licence_texts():
        w = {t: (1 + x) for t, x in text_weights(text, {}, 10_000).items()}
        terms, need = core(w, TEXT_THRESHOLD)
        total = sum(x * x for x in w.values())
        without = total - sum(w[t] ** 2 for t in terms) + sum(w[t] ** 2 for t in terms[: need - 1])
        assert sqrt(without / total) < TEXT_THRESHOLD and need >= 1
