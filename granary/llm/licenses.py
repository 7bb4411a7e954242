"""Licence scan: sparse TF-IDF cosine of lines and paragraphs to templates, then inheritance along paths.

Statements in a file are its lines and its paragraphs, which are compared with the wordings of notices and headers,
and its whole text, which is compared with the licences' own texts as published. A statement near enough to a template
names the file's own licence; a file whose name or whole content is a licence speaks for its directory. A file without
one of its own takes that of its nearest ancestor directory. DataFrame functions throughout.
"""

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import dropped, n_words, saved

#: Licence names and wordings of their notices, as published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Artistic-1.0-Perl", "You may distribute this software under the terms of the Artistic License, as specified in the README file."),
)
#: How a file names a licence by its identifier.
TAG = "SPDX-License-Identifier: "
#: How the versioned licences are named in lower case, what isn't a letter, digit or one of .+()- taken as one space.
NAMED = {
    "tag": r"spdx-license-identifier \(?([a-z0-9.+-]+)",
    "gnu": r"gnu (lesser |library |affero )?general public licen[cs]e(?:.{0,160}?(?:version|v\.?) ?([0-9](?:\.[0-9])?))?",
    "gpl": r"(?:^|[ (])(l|a)?gpl ?-?(?:version|v\.?)? ?-?([0-9](?:\.[0-9])?)",
    "mpl": r"mozilla public licen[cs]e()(?: ?-?(?: version| v\.?)? ?([0-9]\.[0-9]))?",
    "bsl": r"boost software licen[cs]e()(?: ?-?(?: version| v\.?)? ?([0-9]\.[0-9]))?",
    "cc": r"(?:cc|creative commons)[ -](?:by|attribution)((?:[ -](?:noncommercial|sharealike|noderivatives|nc|sa|nd))*)(?: ?-?v?([0-9]\.[0-9]))?",
    "apache": r"apache(?: software)?()(?: licen[cs]e)?(?: version| v\.?)?[ -]?([0-9]\.[0-9])?",
}
#: Kinds of the GNU licences, and short forms of the parts of the Creative Commons ones.
GNU_KINDS = {"": "gpl", "lesser": "lgpl", "library": "lgpl", "affero": "agpl", "l": "lgpl", "a": "agpl"}
CC_PARTS = {"noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd"}
#: Beginnings of the names that a text must state itself, version and all.
STATED = ("gpl-", "lgpl-", "agpl-", "mpl-", "bsl-", "cc-by", "apache-")
#: Cosine from which a whole text is a licence's; the part of a licence's squared weights that its core terms hold.
TEXT_THRESHOLD, CORE = 0.85, 0.6
TOKEN = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
#: Names of files that hold the licence of their directory.
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.\-_][^/]*)?$"
#: Cosine from which a statement is a template's, and the share of a file's words from which it is a licence file.
THRESHOLD, FILE_PERCENT = 0.7, 50
#: Of how many documents one must hold a term for it to be a common one.
COMMON = 100


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def idf_of(df: int, n: int) -> float:
    return log((1 + n) / (1 + df)) + 1


def stated_name(text: Column) -> tuple[Column, Column]:
    """The identifier in the text's tag, and the versioned licence it names first (in lower case, without a version if none
    is given); null if there is none."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9.+()-]+", " ")
    has = lambda kind: plain.rlike(NAMED[kind])
    part = lambda kind, i: F.trim(F.regexp_extract(plain, NAMED[kind], i))
    whole = lambda v: F.when(v.contains(".") | (v == ""), v).otherwise(F.concat(v, F.lit(".0")))
    kinds = F.create_map(*[F.lit(x) for pair in GNU_KINDS.items() for x in pair])
    parts = F.regexp_replace(part("cc", 1), " ", "-")
    for long, short in CC_PARTS.items():
        parts = F.regexp_replace(parts, long, short)
    tag = F.when(has("tag"), F.regexp_replace(part("tag", 1), r"(-only|-or-later|\+)$", ""))
    name = F.when(has("gnu"), F.concat(kinds[part("gnu", 1)], F.lit("-"), whole(part("gnu", 2)))).when(has("gpl"), F.concat(kinds[part("gpl", 1)], F.lit("-"), whole(part("gpl", 2))))
    for kind in ("mpl", "bsl"):
        name = name.when(has(kind), F.concat(F.lit(f"{kind}-"), part(kind, 2)))
    name = name.when(has("cc"), F.concat(F.lit("cc-by"), F.when(parts.startswith("-") | (parts == ""), parts).otherwise(F.concat(F.lit("-"), parts)), F.lit("-"), part("cc", 2)))
    return tag, name.when(has("apache"), F.concat(F.lit("apache-"), F.when(part("apache", 2) == "", "2.0").otherwise(part("apache", 2))))


def licence_texts() -> list[tuple[str, str]]:
    """Name and published text of each file in licence_texts, in the order of their names."""
    return [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def text_weights(text: str, df: dict[str, int], n: int) -> dict[str, float]:
    """Weights in a whole text: often repeated terms count by the logarithm, terms in every document don't count."""
    return {t: (1 + log(c)) * log((1 + n) / (1 + df.get(t, 0))) for t, c in Counter(tokens(text)).items()}


def core(weights: dict[str, float], threshold: float) -> tuple[list[str], int]:
    """The heaviest terms, with CORE of the squared weights, and how many of them a text must hold to reach the threshold."""
    total, upto, terms, need = sum(w * w for w in weights.values()), 0.0, [], 0
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        if upto >= CORE * total:
            break
        if upto < (threshold**2 - (1 - CORE)) * total:
            need += 1
        upto += weights[t] ** 2
        terms.append(t)
    return terms, need


def anchors(weights: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a statement must hold one to come near the template: without them, all the others together
    stay below the threshold."""
    norm, out, dropped = sum(w * w for w in weights.values()), set(weights), 0.0
    for t in sorted(weights, key=lambda t: (weights[t], t)):
        dropped += weights[t] ** 2
        if sqrt(dropped / norm) >= threshold:
            break
        out.discard(t)
    return out


def any_of(words: list[str]) -> str:
    """A pattern for any of the words (longest first) that tries each first letter once, and so on."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    rest = [re.escape(c) + any_of(tails) for c, tails in heads.items() if c]
    if not rest:
        return ""
    return (rest[0] if len(rest) == 1 and "" not in heads else f"(?:{'|'.join(rest)})") + ("?" if "" in heads else "")


def _cosines(terms: DataFrame, held: DataFrame, n: int, templates: list[dict[str, float]], weight: Column, idf: Column) -> DataFrame:
    """k, cosines (an array, a number for each template) from terms (k, t, tf) and document frequencies held (t, df)."""
    norms = [sqrt(sum(w * w for w in v.values())) for v in templates]
    vocabulary = sorted(set().union(*templates))
    table = terms.sparkSession.createDataFrame([(t, [v.get(t, 0.0) for v in templates]) for t in vocabulary], "t string, w array<double>")
    weights = held.select("t", "df", idf.alias("idf"))
    # a document's words bound how many terms one in COMMON documents holds: those are sent out, so none meets in one task
    is_common = F.col("df") * COMMON >= n
    frequent, rare = (weights.where(c).select("t", "idf") for c in (is_common, ~is_common))
    looked_up = terms.join(F.broadcast(frequent), "t", "left")
    others = looked_up.where(F.col("idf").isNull()).drop("idf").join(rare, "t").select("t", "k", "tf", "idf")
    both = looked_up.where(F.col("idf").isNotNull()).select("t", "k", "tf", "idf").unionAll(others)
    weighed = both.join(F.broadcast(table), "t", "left").withColumn("x", weight)
    dots = [F.sum(F.coalesce(F.col("x") * F.col("w")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(templates))]
    sums = weighed.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    return sums.select("k", F.array(*[F.coalesce(F.try_divide(F.col(f"d{i}"), F.col("norm") * F.lit(m)), F.lit(0.0)) for i, m in enumerate(norms)]).alias("cosines"))


def _best(scored: DataFrame, names: list[tuple[str, bool]], threshold: float, first: int) -> DataFrame:
    """``scored`` (cosines, _text) with best (score, order, license): the nearest template, if it is near enough and the text
    doesn't name another licence or version; ties by the templates' order. names: licence, and whether the template is a tag."""
    tag, named = stated_name(F.col("_text"))
    found = []
    for i, (name, is_tag) in enumerate(names):
        low = name.lower()
        fits = F.col("_tag") == low if is_tag else F.coalesce(F.col("_tag") == low, F.lit(True)) & (F.coalesce(F.col("_named") == low, F.lit(False)) if low.startswith(STATED) else F.lit(True))
        found.append(F.when(fits, F.struct(F.round(F.col("cosines")[i], 6).alias("score"), F.lit(-first - i).alias("order"), F.lit(name).alias("license"))))
    near = scored.where(F.array_max("cosines") >= threshold - 1e-6).withColumns({"_tag": tag, "_named": named})
    return near.withColumn("best", F.array_max(F.array(*found))).where(F.col("best.score") >= threshold).drop("_tag", "_named", "cosines")


def scanned(
    spark: SparkSession, files: DataFrame, path: Column, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """id, path, own_license, own_score, is_licence_file, license, license_from, found for every row of ``files``.

    ``templates`` are notices and headers, ``texts`` whole licences (default: those of licence_texts); a tag with each one's name
    is a template too. A template of a licence with versions fits only what names that licence and version itself, and
    what has a tag is named by it alone. ``found`` lists every licence stated; own_license is the nearest (ties: the
    templates' order, then the tags' and the texts'). Document
    frequencies of all terms are counted over all rows. Null and empty texts state nothing; long ones are read whole. Null
    paths lie in no directory. When licence files of one directory disagree, the best match holds, ties by name. Rows
    must have distinct ids; repeated rows share their result; rows with a null id state nothing. An empty table gives no
    row. Other columns, whatever their names, are not read.
    """
    texts = licence_texts() if texts is None else texts
    named = [(name, False) for name, _ in templates]
    for name in dict.fromkeys(name for name, _ in [*templates, *texts] if name != "Proprietary"):
        templates, named = (*templates, (name, TAG + name)), [*named, (name, True)]
    vocabulary = sorted({t for _, text in [*templates, *texts] for t in tokens(text)})
    rows = files.select(files[id_col].alias("_id"), path.alias("_path"), files[text_col].alias("_text"))
    # what is joined later must not carry the texts
    names = rows.select("_id", "_path", n_words(F.col("_text")).alias("_words"))
    # the documents that hold each term; only those of the templates' terms reach the driver
    present = rows.select(F.explode(F.array_distinct(tokens_of(F.col("_text")))).alias("t"))
    held = saved(present.groupBy("t").agg(F.count("*").alias("df")), "frequencies")
    n = rows.count()
    df = {r["t"]: r["df"] for r in held.join(F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "t string")), "t").collect()}
    vectors = [{t: c * idf_of(df.get(t, 0), n) for t, c in Counter(tokens(text)).items()} for _, text in templates]
    needed = sorted(set().union(*(anchors(v, threshold) for v in vectors)))
    word = rf"(?i)(?<![a-z]){any_of(needed)}(?![a-z])"
    # statements: lines, and paragraphs of several lines
    stated = rows.where(F.col("_id").isNotNull() & F.col("_text").rlike(word)).select("_id", "_text")
    parts = F.concat(F.split("_text", "\n"), F.filter(F.split("_text", r"\n\s*\n"), lambda s: s.contains("\n")))
    stated = stated.select("_id", F.explode(parts).alias("s"))
    # a statement that occurs often is scored once; its digest stands for it, as a paragraph may be long
    statements = saved(stated.where(F.col("s").rlike(word)).withColumn("k", F.sha2("s", 256)).groupBy("_id", "k").agg(F.first("s").alias("s"), F.count("*").alias("times")), "statements")
    terms = statements.dropDuplicates(["k"]).select("k", F.explode(tokens_of(F.col("s"))).alias("t")).groupBy("k", "t").agg(F.count("*").alias("tf"))
    cosines = _cosines(terms, held, n, vectors, F.col("tf") * F.col("idf"), F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    hits = _best(statements.join(cosines, "k").withColumn("_text", F.col("s")), named, threshold, 0)
    # whole texts: only of files that hold enough core terms of one licence
    wholes = [text_weights(text, df, n) for _, text in texts]
    cores = [core(w, TEXT_THRESHOLD) for w in wholes]
    of_term: dict[str, list[int]] = {}
    for i, (core_terms, _) in enumerate(cores):
        for t in core_terms:
            of_term.setdefault(t, []).append(i)
    core_table = F.broadcast(spark.createDataFrame(sorted(of_term.items()), "t string, of array<int>"))
    held_terms = rows.where(F.col("_id").isNotNull()).select("_id", F.explode(F.array_distinct(tokens_of(F.col("_text")))).alias("t")).join(core_table, "t")
    needs = F.lit([need for _, need in cores])
    likely = held_terms.select("_id", F.explode("of").alias("i")).groupBy("_id", "i").agg(F.count("*").alias("n")).where(F.col("n") >= needs[F.col("i")])
    likely = saved(likely.select("_id").distinct(), "likely")
    whole = rows.join(likely, "_id", "left_semi").select("_id", F.sha2("_text", 256).alias("k"), "_text")
    whole_terms = whole.dropDuplicates(["k"]).select("k", F.explode(tokens_of(F.col("_text"))).alias("t")).groupBy("k", "t").agg(F.count("*").alias("tf"))
    whole_cosines = _cosines(whole_terms, held, n, wholes, (1 + F.log("tf")) * F.col("idf"), F.log(F.lit(1.0 + n) / (1 + F.col("df"))))
    whole_matched = _best(whole.join(whole_cosines, "k"), [(name, False) for name, _ in texts], TEXT_THRESHOLD, len(templates))
    of_whole = saved(whole_matched.groupBy("_id").agg(F.max("best").alias("whole")), "whole")
    # of lines only: a paragraph counts its lines' words again
    of_file = hits.groupBy("_id").agg(
        F.max("best").alias("stated"), F.collect_set("best.license").alias("names"), F.sum(F.when(F.col("s").contains("\n"), 0).otherwise(n_words(F.col("s")) * F.col("times"))).alias("line_words"), F.max(F.when(F.col("s").contains("\n"), n_words(F.col("s")))).alias("paragraph_words"),
    )
    share = 100 * F.greatest("line_words", F.coalesce("paragraph_words", F.lit(0))) >= FILE_PERCENT * F.col("_words")
    directory = F.regexp_replace("_path", r"/?[^/]*$", "")
    own = F.greatest("stated", "whole")  # nulls are passed over
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("whole").isNotNull(), F.array("whole.license")).otherwise(F.array().cast("array<string>")))))
    speaks_for = own.isNotNull() & F.col("_path").isNotNull() & F.coalesce(F.col("whole").isNotNull() | F.col("_path").rlike(LICENCE_FILE) | share, F.lit(False))
    joined = names.join(of_file, "_id", "left").join(of_whole, "_id", "left")
    marked = saved(joined.select("_id", "_path", directory.alias("_dir"), own.alias("own"), every.alias("found"), speaks_for.alias("is_file")), "marked")
    speaks = marked.where("is_file").groupBy(F.col("_dir").alias("above")).agg(F.max(F.struct(F.col("own.score").alias("score"), F.col("own.order").alias("order"), F.col("own.license").alias("license"))).alias("says"))
    # each distinct directory, joined with all its ancestors
    above = marked.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.filter(F.split("_dir", "/"), lambda p: p != "")
    lead = F.when(F.col("_dir").startswith("/"), "/").otherwise("")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(lead, F.array_join(F.slice(parts, F.lit(1), k), "/")))
    heirs = (
        above.select("_dir", F.posexplode(F.array_append(ancestors, F.col("_dir"))).alias("depth", "above"))
        .join(speaks, "above")
        .groupBy("_dir")
        .agg(F.max(F.struct("depth", "above", "says")).alias("heir"))
    )
    dropped(held, statements, likely, of_whole)
    out = marked.join(heirs, "_dir", "left")
    inherited = F.col("heir.says.license")
    return out.select(
        F.col("_id").alias(id_col), F.col("_path").alias("path"), F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score"), F.col("is_file").alias("is_licence_file"),
        F.coalesce("own.license", inherited).alias("license"), F.when(F.col("own").isNotNull(), F.lit("own")).when(inherited.isNotNull(), F.concat(F.lit("dir:"), F.col("heir.above"))).alias("license_from"),
        "found",
    )
